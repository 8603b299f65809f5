"""What Python makes of a batch is handed on in parts: neither a batch for every row nor all of it at once."""

import pyarrow as pa

from shelfspark import shipping
from shelfspark.sources import opds


class Held:
    """Stands for a DataFrame: what mapInArrow was given, run over one batch, as record batches."""

    def __init__(self, spark, batch):
        self.sparkSession, self.batch = spark, batch

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run(iter([self.batch])))


def test_feeds_of_one_batch_go_on_in_parts(spark):
    entry = "<entry><id>1</id>" + "<link rel='http://opds-spec.org/acquisition' type='application/pdf' href='x'/>" * 100 + "</entry>"
    text = '<feed xmlns="http://www.w3.org/2005/Atom">' + entry * 20 + "</feed>"
    n = 4 * shipping.MOST_BYTES // len(text) + 1
    got = opds.feeds(Held(spark, pa.RecordBatch.from_pydict({"address": ["http://a"] * n, "text": [text] * n})))
    assert sum(b.num_rows for b in got) == n and len(got) >= 4


def test_small_rows_share_a_batch():
    rows = [({"a": i}, 1) for i in range(2 * shipping.MOST_ROWS + 1)]
    assert [b.num_rows for b in shipping.in_batches(rows, pa.schema([("a", pa.int64())]))] == [shipping.MOST_ROWS, shipping.MOST_ROWS, 1]


def test_sessions_have_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    shipping.ship(spark)
    assert spark.conf.get(name) == f"{shipping.BATCH_BYTES}b"
