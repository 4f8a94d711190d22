"""Readers and writers. All go through Spark's file sources, so paths may be local or remote, one file or many."""
