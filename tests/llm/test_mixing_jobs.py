"""Raking works on few cells, so that it has to be small on the driver, too."""

import uuid

from talkloom.llm import mixing as M


def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "raking")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)


def test_exchanges_of_cells_are_no_jobs(spark):
    rows = [(i, f"s{i % 5}", ["en", "de", "es"][i % 7 % 3], f"t{i % 11 % 4}", 10 + i % 13 * (i % 5)) for i in range(2000)]
    described = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    set_before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    assert jobs_of(spark, lambda: M.rates(described, keep=0.9, bound=0.001).count()) <= 40
    assert {k: spark.conf.get(k) for k in set_before} == set_before


def test_many_cells_are_dealt_out(spark, monkeypatch):
    rows = [(i, f"s{i % 5}", f"l{i % 7}", f"t{i % 3}", 10 + i % 13) for i in range(1000)]
    described = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    of_cell = lambda: {r[:3]: r.probability for r in M.rates(described, keep=0.9, bound=0.001).collect()}
    few = of_cell()
    monkeypatch.setattr(M, "CELLS", 20)
    many = of_cell()
    assert few.keys() == many.keys() and max(abs(few[c] - many[c]) for c in few) < 1e-9
