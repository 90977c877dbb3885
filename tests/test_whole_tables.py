"""Queries that once took a subset run over the whole table."""

from pyspark.sql import functions as F

from rillflow import catalog
from rillflow.session import table


def test_whole_tables(spark, sf_dir):
    queries = catalog.queries()
    run = lambda name: queries[name](spark, sf_dir)
    assert run("u1_scalar_udf").count() == table(spark, sf_dir, "customer").count()
    assert run("p5_replicate").count() == table(spark, sf_dir, "lineitem").agg(F.sum(F.col("l_quantity").cast("int"))).first()[0]
    assert run("p15_app_log").where("kind <> 'display'").agg(F.sum("n")).first()[0] == table(spark, sf_dir, "events").count()
    assert run("c14_tokens").where("n <= 20").count() > 0
    assert run("a1_word_count").where("n <= 30").count() > 0
