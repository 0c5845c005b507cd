"""Edge labelling, pruning, sampling and scoring over very large edge tables, written for Spark."""
