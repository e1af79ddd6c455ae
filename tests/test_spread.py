"""Work on keys of a small file runs on all cores; pages are read as before."""

from terncove.functions import harvest as H
from terncove.plans import catalogue, discover
from terncove.plans.catalogue import PAGE, Tables, formed


def test_keys_of_one_file_are_dealt_over_all_cores(spark):
    pages = formed(Tables(spark, "/root/testdata/sf0.001"), "x string", [(PAGE,)])
    assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sum(n > 0 for n in pages.rdd.glom().map(len).collect()) > 1


def test_walks_are_in_page_order_and_deep_trees_end():
    root = H.parse("<a>1<b>2<i>3</i>4</b>5</a><script>s</script><p>6" + "<div>" * 3000 + "7")
    assert root.text() == "12345s67"
    assert "".join(root.pieces(H.SILENT)) == "1234567"
    assert [n.tag for n in root.walk()][:6] == ["#root", "a", "b", "i", "script", "p"]


def test_run_log_needs_no_dedupe(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("the log asked for duplicates")

    monkeypatch.setattr(discover, "dedupe", refuse)
    assert catalogue.QUERIES["q07_run_log"](spark, "/root/testdata/sf0.001").count() > 0
