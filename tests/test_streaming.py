import pytest

from hornbeam import errors as E
from hornbeam.features import Features
from hornbeam.lang.parser import parse
from hornbeam.streaming.incremental import Incremental

PROGRAM = ".assert e(integer, integer).\np(X, Y) :- e(X, Y). p(X, Y) :- e(X, Z), p(Z, Y). loop(X) :- p(X, X)."


def test_batches_reach_the_same_fixpoint(spark, tmp_path):
    inc = Incremental(parse(PROGRAM), spark)
    edges = [(1, 2), (3, 4), (2, 3), (4, 1), (3, 4)]
    for i in range(0, 5, 2):
        spark.createDataFrame(edges[i : i + 2], "a long, b long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("a long, b long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream.writeStream.foreachBatch(inc.sink("e")).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in inc.relation("p").collect()} == {(a, b) for a in range(1, 5) for b in range(1, 5)}
    assert inc.relation("loop").count() == 4 and inc.relation("e").count() == 4
    inc.apply("e", spark.createDataFrame([(9, 9)], "a long, b long"), 0)  # an id seen before
    assert inc.relation("e").count() == 4


def test_negation_is_refused(spark):
    with pytest.raises(E.FeatureUnsupported):
        Incremental(parse("q(a). p(X) :- q(X), NOT r(X). r(b) :- q(b).", Features.all()), spark)
