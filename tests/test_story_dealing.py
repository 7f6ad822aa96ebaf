"""Tables of a story stay where they were dealt: numbering, neighbours and joins add no shuffle of their rows."""

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from longform.functions.seq import block_of, seq_number, with_neighbour
from longform.operators.prompts import req_compress
from longform.operators.writing import context_text
from longform.session import plain_session, story_session
from longform.sources import fixtures
from longform.sources.fixtures import Fixtures, by_story

ROWS = [(1, 1, 2), (1, 1, 1), (1, 2, 5), (1, None, 9), (2, 5000, 1), (2, 4, 3), (None, 2, 2), (None, 1, 7), (None, None, 1)]


def test_numbering_equals_row_number_with_null_keys_and_blocks(spark):
    df = spark.createDataFrame(ROWS, "story_id long, b long, o long")
    got = seq_number(df, ["story_id"], ["o"], "n", block=[F.col("b")])
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("story_id").orderBy("b", "o")).cast("long"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_numbering_keeps_rows_where_they_are(spark):
    story_session(spark)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = by_story(spark.createDataFrame(ROWS, "story_id long, b long, o long"))
        n = seq_number(df, ["story_id"], ["o"], "n", block=[block_of("o")])
        n = with_neighbour(n, ["story_id"], "n", ["b"])
        # one for each reading of the table (rows and block counts, twice), all of them the dealing itself
        plan = n._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_other_queries_do_not_keep_the_settings(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    story_session(spark)
    assert spark.conf.get(name) == "false"
    plain_session(spark)
    assert spark.conf.get(name) == "true"


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string"
LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, "
         "l_linestatus string, l_shipdate timestamp")


def _tables(spark, path, lines):
    day = datetime(1997, 1, 1)
    orders = [(1, 7, "F", day, "1-URGENT"), (2, 7, "O", day, "2-HIGH"), (3, 7, "F", datetime(1998, 1, 1), "5-LOW")]
    for name, rows, schema in (("orders", orders, ORDERS), ("lineitem", lines, LINES)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return Fixtures(spark, str(path))


def test_lines_equal_in_all_four_columns_have_one_order(spark, tmp_path):
    twins = [(1, 5, 0, 4, 43.0, "N", "O", datetime(1998, 5, 25)), (1, 5, 0, 4, 19.0, "N", "O", datetime(2001, 7, 19))]
    ids = []
    for i, lines in enumerate((twins, twins[::-1])):
        s = _tables(spark, tmp_path / str(i), lines).sub_events
        ids.append({r["l_quantity"]: (r["sub_seq"], r["sub_event_id"]) for r in s.collect()})
    assert ids[0] == ids[1] == {19.0: (1, "E1_S4"), 43.0: (2, "E1_S4_1")}


def test_relations_have_all_variants_from_one_pass(spark, tmp_path):
    day = datetime(1998, 5, 25)
    f = _tables(spark, tmp_path, [(k, 5, 0, 1, 1.0, "N", "O", day) for k in (1, 2, 3)])
    got = [(r["rel_seq"], r["type"], r["source_event_id"], r["target_event_id"]) for r in f.relations.collect()]
    assert sorted(got) == [(1, "temporal", "E1", "E2"), (2, "temporal", "E1", "E2"), (3, "temporal", "E2", "E3"),
                           (4, "temporal", "E3", "E2")]


def test_parts_of_stories_grow_with_the_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "PART_BYTES", 256, raising=False)
    day = datetime(1998, 5, 25)
    f = _tables(spark, tmp_path, [(k, 5, 0, 1, 1.0, "N", "O", day) for k in (1, 2, 3)])
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f.order_keys.rdd.getNumPartitions() == f.sub_event_keys.rdd.getNumPartitions() > usual


CAST = "array<struct<name:string,role:string,state:string>>"


def _context_tables(spark):
    def events(*rows):
        return spark.createDataFrame([(1, i, k, k, "", "", "", [], "", "", 0.0, 0.0) for i, k in rows], (
            f"story_id long, event_seq long, event_id string, title string, summary string, time string, location string, "
            f"characters {CAST}, goal string, conflict string, novelty_score double, coherence_score double"))
    subs = spark.createDataFrame([(1, 1, "a", "E1", "A", "", []), (1, 2, "b", "E1", "B", "", []), (1, 3, "c", "E2", "C", "", []),
                                  (1, 4, "d", "E9", "D", "", [])],
                                 f"story_id long, sub_seq long, sub_event_id string, parent_event_id string, title string, "
                                 f"summary string, characters {CAST}")
    order = ["a", "b", "a", "c", "b", "d", "x"]
    slots = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(order)], "story_id long, pos long, sub_event_id string")
    passages = spark.createDataFrame(
        [(1, i + 1, x, "s", 0.5, f"text {i + 1}", "", [], "", 0.0) for i, x in enumerate(order[:5])],
        "story_id long, pos long, sub_event_id string, summary_text string, relevance_score double, raw_text string, "
        "suggestions string, issues array<string>, revised_text string, confidence double")
    links = spark.createDataFrame([(1, 1, "causal", "E1", "E2", "")], "story_id long, rel_seq long, type string, "
                                  "source_event_id string, target_event_id string, rationale string")
    return slots, subs, events, links, passages


def _told(text):
    """What a context shows: event ids, titles of sub-events and raw texts, in order."""
    import json
    lines = [json.loads(x) for x in text.split("\n") if x]
    return [x.get("raw_text") or x.get("event_id") or x["title"] for x in lines]


def test_a_context_shows_siblings_with_their_latest_earlier_passage(spark):
    slots, subs, events, links, passages = _context_tables(spark)
    got = context_text(slots, subs, events((1, "E1"), (2, "E2")), links, passages).collect()
    assert {r["pos"]: _told(r["context"]) for r in got} == {
        1: ["E1", "E2", "B"], 2: ["E1", "E2", "A", "text 1"], 3: ["E1", "E2", "B", "text 2"], 4: ["E2", "E1"],
        5: ["E1", "E2", "A", "text 3"], 6: []}
    # passages that are there twice are shown twice, an event that is there twice has two rows
    got = context_text(slots, subs, events((1, "E1"), (2, "E1")), links, passages.unionAll(passages)).collect()
    assert sorted(_told(r["context"]) for r in got if r["pos"] == 2) == [["E1", *["A", "text 1"] * 4]] * 2


def test_contexts_are_joined_without_sorting_them(spark):
    slots, subs, events, links, passages = _context_tables(spark)
    stories = spark.createDataFrame([(1, "p")], "story_id long, premise string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = req_compress(stories, context_text(slots, subs, events((1, "E1"), (2, "E2")), links, passages), subs)
        assert r._jdf.queryExecution().executedPlan().toString().count("ShuffledHashJoin") == 2
        assert r.count() == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_counters_neither_make_nor_keep_texts(spark):
    """Events and passages are counted without the lines and names that their texts are made of."""
    from longform.catalog import queries
    from longform.catalog.common import fx
    sf = "/root/testdata/sf0.001"
    got = queries()["run_counters"](spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_lines#" not in plan and "p_name" not in plan
    f = fx(spark, sf)
    totals = {r["stage"]: r["n"] for r in got.where("story_id IS NULL").collect()}
    assert totals["events"] == f.events.count() and totals["passages"] == f.passages.count()
