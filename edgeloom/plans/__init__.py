"""Registered queries over the test tables, with the SQL that checks them."""

from edgeloom.plans import evaluation_plans as evaluation_plans
from edgeloom.plans import graph_plans as graph_plans
from edgeloom.plans import labelling as labelling
from edgeloom.plans import learning_plans as learning_plans
from edgeloom.plans import model_plans as model_plans
from edgeloom.plans import sampling_plans as sampling_plans
from edgeloom.plans import set_plans as set_plans
from edgeloom.plans import text_plans as text_plans
from edgeloom.plans.registry import ORACLES as ORACLES
from edgeloom.plans.registry import QUERIES as QUERIES
