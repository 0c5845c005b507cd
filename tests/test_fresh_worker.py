"""What a task runs loads its own modules: its worker may be new, or have run other tasks before."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa

#: A table comes as Spark sends it, since making one by pa.array loads more of Arrow.
PART = """
import sys
import pyarrow as pa
from edgeloom.operators import subsets

print(subsets._met((0, 0), pa.ipc.open_stream(sys.stdin.buffer).read_all(), 3).to_pylist())
"""


def test_subsets_are_counted_in_a_new_process():
    subset, mask = pa.array([None, None, [0, 2]], pa.list_(pa.int32())), pa.array([[5], [3], None], pa.list_(pa.int64()))
    table = pa.table({"mask": mask, "edges": pa.array([7, 2, None], pa.int64()), "subset": subset})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    done = subprocess.run([sys.executable, "-c", PART], cwd=Path(__file__).resolve().parents[1], input=sink.getvalue().to_pybytes(), capture_output=True)
    assert done.returncode == 0, done.stderr.decode()
    assert done.stdout.decode().strip() == str([{"subset": [0, 2], "union_size": 9, "intersection_size": 7}])
