"""Edge cases of FIXTURES.md section 3, the skew path of the numbering, and the parsers' coercion rules."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from longform.functions.ids import resolve_ids
from longform.functions.seq import seq_number
from longform.operators import outline as O
from longform.operators import parse as R
from longform.operators import writing as W


def test_seq_number_matches_window_and_keeps_null_keys(spark):
    rows = [(1 if i % 10 else (2 if i % 20 else None), i, (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, id long, v long")
    got = seq_number(df, ["k"], ["v", "id"], "s", block=[F.floor(F.col("v") / 100)])
    want = got.withColumn("w", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")))
    assert got.count() == 3000
    assert want.where("s != w").count() == 0


def _resolve(spark, ids):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate(ids)], "story_id long, seq long, event_id string")
    r = resolve_ids(df, ["story_id"], "event_id", "seq", "out")
    return [x.out for x in r.orderBy("seq").collect()]


def test_id_suffix_with_natural_suffix(spark):
    assert _resolve(spark, ["E1", "E1", "E1_1"]) == ["E1", "E1_1", "E1_1_1"]
    assert _resolve(spark, ["E1_1", "E1", "E1"]) == ["E1_1", "E1", "E1_2"]
    assert _resolve(spark, ["E2", "E2", "E2"]) == ["E2", "E2_1", "E2_2"]
    assert _resolve(spark, ["event_1", "event_2", "event_1", "event", "event"]) == [
        "event_1", "event_2", "event_1_1", "event", "event_3"]


def test_same_id_twice_in_batch_last_wins_first_position(spark):
    c = spark.createDataFrame([(1, 0, 0, 0, "E1", "a"), (1, 0, 0, 1, "E2", "x"), (1, 0, 0, 2, "E1", "b")],
                              "story_id long, round int, val_iter int, pos int, event_id string, title string")
    d = {r.event_id: (r.first_pos, r.title) for r in O.dedupe_candidates(c).collect()}
    assert d == {"E1": (0, "b"), "E2": (1, "x")}


def test_verdict_for_unknown_id(spark):
    c = spark.createDataFrame([(1, 0, 0, 0, "E1", "a")],
                              "story_id long, round int, val_iter int, pos int, event_id string, title string")
    v = spark.createDataFrame([(1, 0, 0, 0, "E9", True, "")],
                              "story_id long, round int, val_iter int, pos int, event_id string, valid boolean, "
                              "suggestion string")
    assert O.accepted_split(c, v).count() == 0
    assert O.revise_queue(c, v).count() == 0
    assert [r.event_id for r in O.unvalidated_candidates(c, v).collect()] == ["E1"]


def test_soft_cap(spark):
    schema = "story_id long, round int, val_iter int, pos int, event_id string, title string"
    c = spark.createDataFrame([(1, 0, 0, 0, "A", "t"), (1, 0, 0, 1, "B", "t"),
                               (1, 1, 0, 0, "C", "t"), (1, 1, 0, 1, "D", "t"), (1, 1, 0, 2, "E", "t"),
                               (1, 2, 0, 0, "F", "t")], schema)
    v = c.select("story_id", "round", "val_iter", "pos", "event_id", F.lit(True).alias("valid"),
                 F.lit("").alias("suggestion"))
    comp = spark.createDataFrame([(1, r, False) for r in range(3)], "story_id long, round int, complete boolean")
    out = O.outline_fold(c, v, comp, max_events=3, max_val=2)
    assert sorted(r.event_id for r in out.collect()) == ["A", "B", "C", "D", "E"]


def test_dangling_self_and_parallel_edges(spark):
    ev = spark.createDataFrame([(1, "E1", 1), (1, "E2", 2)], "story_id long, event_id string, event_seq long")
    rel = spark.createDataFrame([(1, 1, "causal", "E1", "E9", ""), (1, 2, "causal", "E1", "E1", ""),
                                 (1, 3, "causal", "E1", "E2", ""), (1, 4, "causal", "E1", "E2", "")],
                                "story_id long, rel_seq long, type string, source_event_id string, "
                                "target_event_id string, rationale string")
    kept = O.relations_valid(rel, ev)
    assert kept.count() == 3
    nb = sorted(r.neighbour_id for r in W.event_adjacency(kept).where("event_id = 'E1'").collect())
    assert nb == ["E1", "E2"]


def test_next_title_at_end_of_range(spark):
    ch = spark.createDataFrame([(1, i, i, f"T{i}") for i in range(1, 5)],
                               "story_id long, chapter_pos long, chapter_id int, title string")
    r = W.next_chapter_title(W.chapter_range(ch, 2, 3)).orderBy("chapter_pos").collect()
    assert [(x.chapter_id, x.next_title) for x in r] == [(2, "T3"), (3, W.NO_MORE_CHAPTERS)]


def test_chapter_ids_out_of_order_and_repeated_sub_event(spark):
    ch = spark.createDataFrame([(1, 1, 2, ["S1", "S2"]), (1, 2, 1, ["S1"])],
                               "story_id long, chapter_pos long, chapter_id int, sub_event_ids array<string>")
    r = W.reading_order(ch).orderBy("pos").collect()
    assert [(x.pos, x.sub_event_id) for x in r] == [(1, "S1"), (2, "S2"), (3, "S1")]
    latest = {(x.sub_event_id, x.pos): x.prev_pos for x in W.passage_latest(W.reading_order(ch)).collect()}
    assert latest[("S1", 3)] == 1 and latest[("S1", 1)] is None


def test_empty_revision_keeps_raw_text(spark):
    p = spark.createDataFrame([(1, 1, "raw one", ""), (1, 2, "raw two", "better two")],
                              "story_id long, pos long, raw_text string, revised_text string")
    assert W.final_text(p).collect()[0].final_text == "raw one\n\nbetter two"


def _parse(spark, texts, spec):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "rid long, response_text string")
    return R.parse_records(df, ["rid"], spec)


def test_parse_coercion_rules(spark):
    good, bad = _parse(spark, [
        '[{"event_id": "E1", "suggestion": "", "valid": "yes"}, {"event_id": 5, "suggestion": "", "valid": true},'
        ' {"event_id": "E3", "suggestion": "", "valid": 2}, {"event_id": "E4", "valid": false},'
        ' {"event_id": "E5", "suggestion": "s", "valid": 0, "extra": 1}]'], R.VERDICT_SPEC)
    assert sorted((r.event_id, r.valid) for r in good.collect()) == [("E1", True), ("E5", False)]
    assert bad.count() == 3


def test_parse_single_object_and_number_as_text(spark):
    good, _ = _parse(spark, ['Sure! {"summary_text": "s", "relevance_score": "0.5"}'], R.COMPRESS_SPEC)
    rows = good.collect()
    assert len(rows) == 1 and rows[0].relevance_score == 0.5


def test_completeness_default_on_plain_text(spark):
    df = spark.createDataFrame([(1, "Sorry")], "rid long, response_text string")
    r = R.parse_completeness(df, ["rid"]).collect()[0]
    assert (r.complete, r.reason, r.missing_elements) == (False, "Parse error", ["unknown"])


def test_salvage_cut_off_list():
    fixed = R.salvage_json('[{"a": 1},{"event_id":"E2"')
    assert fixed == '[{"a":1},{"event_id":"E2"}]'
    assert R.salvage_json("no json here") is None


def test_repair_of_sloppy_texts(spark):
    good, bad = _parse(spark, [
        '[{"event_id": "A", "suggestion": "", "valid": true}, {"event_id": "B", "sugg',   # cut off
        '[{"event_id": "C", "suggestion": "", "valid": true},]',                           # trailing comma
        "[{'event_id': 'D', 'suggestion': 'say \"no\"', 'valid': false}]",                 # single quotes
        '{"event_id": "E", "event_id": "F", "suggestion": "", "valid": true}',             # repeated key
        'Here [note]: [{"event_id": "G", "suggestion": "", "valid": true}]',               # bracket in chatter
        'see [1] {"event_id": "H", "suggestion": "it\'s", "valid": true} and [2]',
        'nothing here', '', None], R.VERDICT_SPEC)
    rows = {r.event_id: r.suggestion for r in good.collect()}
    assert sorted(rows) == ["A", "C", "D", "F", "G", "H"]
    assert rows["D"] == 'say "no"' and rows["H"] == "it's"
    assert sorted((r.rid, r.reason) for r in bad.collect()) == [
        (0, "bad suggestion"), (6, "no JSON"), (7, "no JSON"), (8, "no JSON")]


def test_object_is_repaired_before_the_default(spark):
    df = spark.createDataFrame([(1, "{'complete': true, 'reason': 'done',}")], "rid long, response_text string")
    r = R.parse_completeness(df, ["rid"]).collect()[0]
    assert (r.parsed_ok, r.complete, r.reason, r.missing_elements) == (True, True, "done", [])


def test_near_duplicate_events_match_brute_force(spark):
    from longform.operators.checks import near_duplicate_events
    rows = [(1, i, f"e{i}", "storm at sea", " ".join(f"w{j}" for j in range(i % 4, 14 + i % 3)), "port", "", None)
            for i in range(1, 13)] + [(2, 1, "e1", "", "", "", "", ""), (2, 2, "e2", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "story_id long, event_seq long, event_id string, title string, summary string, "
                                     "location string, goal string, conflict string")
    got = {(r.story_id, r.event_a, r.event_b, r.shared, r.words) for r in near_duplicate_events(df).collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1]:
                x, y = (set(" ".join(t or "" for t in r[3:]).split()) for r in (a, b))
                if 10 * len(x & y) > 8 * len(x | y):
                    want.add((a[0], a[2], b[2], len(x & y), len(x | y)))
    assert got == want and want


def test_causal_chain_counts_the_longest_forward_chain(spark):
    from longform.operators.checks import causal_chain
    events = spark.createDataFrame([(s, f"e{i}", i) for s in (1, 2, 3) for i in range(1, 6)],
                                   "story_id long, event_id string, event_seq long")
    rel = spark.createDataFrame(
        [(1, "causal", "e1", "e2"), (1, "causal", "e2", "e4"), (1, "causal", "e4", "e1"), (1, "causal", "e1", "e4"),
         (1, "causal", "e4", "e5"), (1, "causal", "e4", "e5"), (2, "temporal", "e1", "e2"), (2, "causal", "e3", "e3"),
         (3, "causal", "e1", "e5"), (3, "causal", "e1", None)],
        "story_id long, type string, source_event_id string, target_event_id string")
    got = {r.story_id: (r.n_links, r.n_events) for r in causal_chain(rel, events).collect()}
    assert got == {1: (3, 4), 3: (1, 2)}
    assert causal_chain(rel.where("false"), events).count() == 0


def test_fold_in_one_pass_numbers_as_append_does(spark):
    rows = [(s, r, v, p, f"E{(s * 31 + r * 7 + v * 3 + p) % 5}", f"t{s}{r}{v}{p}")
            for s in range(12) for r in range(5) for v in range(3) for p in range(3)
            if not (s == 3 and r == 2) and not (s == 4 and v == 0 and r == 1) and not (s == 5 and r == 0)]
    c = spark.createDataFrame(rows, "story_id long, round int, val_iter int, pos int, event_id string, title string")
    v = spark.createDataFrame([(*r[:5], (r[0] + r[1] + r[2] * r[3]) % 3 == 0, "") for r in rows if sum(r[:4]) % 7],
                              "story_id long, round int, val_iter int, pos int, event_id string, valid boolean, "
                              "suggestion string")
    comp = spark.createDataFrame([(s, r, s == 6 and r == 2) for s in range(12) for r in range(5)],
                                 "story_id long, round int, complete boolean")
    prior = spark.createDataFrame([(s, i * 3 + 1, f"E{i}", "old") for s in (1, 2, 40) for i in range(s)],
                                  "story_id long, event_seq long, event_id string, title string")
    cols = ["story_id", "event_seq", "event_id", "title"]
    for old in (None, prior):
        args = (c, v, comp, 6, 2, old)
        slow = O.append_accepted(O.accepted_in_play(*args), old).select(*cols)
        fast = O.accepted_events(*args).select(*cols)
        assert slow.count() == fast.count() > 0
        assert slow.exceptAll(fast).count() == 0
    stops = {r.story_id: r.stop_round for r in O.stop_rounds(c, v, comp, 6, 2, prior).collect()}
    assert set(stops) == set(range(12)) | {40}
    assert stops[40] == 0 and stops[5] == 0 and stops[3] <= 2 and stops[4] <= 1 and stops[6] <= 2
