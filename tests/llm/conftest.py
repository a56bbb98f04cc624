import pytest


@pytest.fixture
def frame(spark):
    """A frame of documents (doc_id, text) with columns whose names an operator might use itself."""

    def make(rows, schema="doc_id long, text string"):
        names = [c.split()[0] for c in schema.split(",")]
        clash = ["ids", "key", "n", "score", "spans", "u", "v", "node", "shard", "size", "part", "block"]
        extra = ", ".join(f"`{c}` string" for c in clash if c not in names)
        k = len(clash)
        return spark.createDataFrame([(*r, *["x"] * k) for r in rows], f"{schema}, {extra}")

    return make
