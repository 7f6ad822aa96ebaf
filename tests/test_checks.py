"""Graph components, names of any shape and sentences repeated from the context, on rows made for them."""

from longform.operators import checks as Q

EVENT = "story_id long, event_id string, event_seq long, characters array<struct<name:string,role:string,state:string>>"
LINK = "story_id long, rel_seq long, source_event_id string, target_event_id string"


def test_components_of_a_long_chain(spark):
    n = 10000
    events = spark.range(1, n + 1).selectExpr("1L AS story_id", "concat('E', id) AS event_id", "id AS event_seq")
    events = events.unionByName(spark.createDataFrame([(2, "A", 1), (2, "B", 2), (2, "C", 3), (2, "D", 4), (3, "A", 1)],
                                                      "story_id long, event_id string, event_seq long"))
    # chain links in an order that does not follow the chain, one story with two parts and a loop, one without links
    chain = spark.range(1, n).selectExpr("1L AS story_id", "id AS rel_seq", "concat('E', id + 1) AS source_event_id",
                                         "concat('E', id) AS target_event_id")
    links = chain.unionByName(spark.createDataFrame(
        [(2, 1, "C", "A"), (2, 2, "A", "C"), (2, 3, "B", "B"), (2, 4, "D", "B")], LINK))
    parts = {(r["story_id"], r["event_id"]): (r["first_seq"], r["n_events"])
             for r in Q.graph_components(events, links).collect()}
    assert {v for (s, _), v in parts.items() if s == 1} == {(1, n)}
    assert {e: v for (s, e), v in parts.items() if s == 2} == {"A": (1, 2), "C": (1, 2), "B": (2, 2), "D": (2, 2)}
    assert parts[3, "A"] == (1, 1) and len(parts) == n + 5


def test_names_of_any_shape(spark):
    cast = ["Zoë", "Ann Lee", "Lord of the Far Northern High Hills", "Lord of the Far Northern Low Hills", "..."]
    events = spark.createDataFrame([(1, "E", 1, [(c, "r", "s") for c in cast])], EVENT)
    subs = spark.createDataFrame([(1, "S", [("Zoë", "r", "s")]), (1, "T", [])],
                                 "story_id long, sub_event_id string, characters array<struct<name:string,role:string,state:string>>")
    said = "Zoë met Ann-Lee; Annabel Lee stayed. The Lord of the Far Northern High Hills, too."
    passages = spark.createDataFrame([(1, 1, "S", said), (1, 2, "T", "Zoë"), (1, 3, "T", ""), (2, 4, "T", "Zoë")],
                                     "story_id long, pos long, sub_event_id string, raw_text string")
    got = {(r["pos"], r["name"]) for r in Q.wrong_names(passages, subs, events).collect()}
    assert got == {(1, "Ann Lee"), (1, "Lord of the Far Northern High Hills"), (2, "Zoë")}


def test_sentences_repeated_from_the_context(spark):
    passages = spark.createDataFrame([(1, 1, "A b. C d."), (1, 2, "C d. E f. C d."), (1, 3, "C d. A b")],
                                     "story_id long, pos long, raw_text string")
    seen = spark.createDataFrame([(1, 2, "x", 1), (1, 3, "x", 1), (1, 3, "y", 2), (1, 1, "y", None)],
                                 "story_id long, pos long, sibling_id string, visible_pos long")
    got = {(r["pos"], r["sentence"], r["n_earlier"]) for r in Q.repeated_in_context(passages, seen).collect()}
    assert got == {(2, "C d", 1), (3, "C d", 2), (3, "A b", 1)}


def _sorted_or_sent(df) -> list[str]:
    """Lines of a plan without small tables that sort or shuffle rows."""
    conf, name = df.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
    kept = conf.get(name)
    conf.set(name, "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.set(name, kept)
    return [x for x in plan.splitlines() if "Sort [" in x or "Exchange hashpartitioning" in x]


PASSAGE = "story_id long, pos long, sub_event_id string, raw_text string, summary_text string"
SEEN = "story_id long, pos long, sibling_id string, sibling_seq long, visible_pos long"


def test_word_runs_pass_the_names_unsorted(spark):
    text = "Ann Lee met Ann Lee. Zoë, Lord of the Far High Hills"
    events = spark.createDataFrame([(1, "E", 1, [(c, "r", "s") for c in (
        "Ann Lee", "Zoë", "Lord of the Far High Hills", "Lord of the Far High Seas", "Far High Hills and More Beyond")])], EVENT)
    subs = spark.createDataFrame([(1, "S", [("Zoë", "r", "s")])],
                                 "story_id long, sub_event_id string, characters array<struct<name:string,role:string,state:string>>")
    passages = spark.createDataFrame([(1, 1, "S", text, ""), (1, 1, "S", text, ""), (1, 2, "S", None, ""), (2, 1, "S", text, ""),
                                      (None, 1, "S", text, "")], PASSAGE)
    r = Q.wrong_names(passages, subs, events)
    assert sorted((x["pos"], x["name"]) for x in r.collect()) == [(1, "Ann Lee"), (1, "Lord of the Far High Hills")]
    assert not [x for x in _sorted_or_sent(r) if "Sort [" in x and "_gram" in x]


def test_new_facts_make_no_row_for_each_word(spark):
    passages = spark.createDataFrame([
        (1, 1, "S", "Red fox. Old oak", "a red fox"), (1, 2, "T", "blue", "Old red moon"), (1, 3, "U", "", "oak oak BLUE sea"),
        (1, 3, "U", "", "oak sand"), (1, 4, "V", "x", None), (1, 5, "W", "x", "..."), (None, 6, "X", "x", "one")], PASSAGE)
    seen = spark.createDataFrame([(1, 2, "S", 1, 1), (1, 3, "S", 1, 1), (1, 3, "T", 2, 2), (1, 1, "T", 2, None)], SEEN)
    r = Q.summary_new_facts(seen, passages)
    got = {(x["story_id"], x["pos"]): (x["n_words"], x["n_new"]) for x in r.collect()}
    assert got == {(1, 1): (3, 3), (1, 2): (3, 1), (1, 3): (5, 2), (None, 6): (1, 1)}
    assert not [x for x in _sorted_or_sent(r) if "word#" in x]


def test_sentences_of_a_history_are_counted_before_they_are_sorted(spark):
    passages = spark.createDataFrame([(1, 1, "S", "Red fox. A moon. Old red oak. Sea", ""), (1, 2, "T", "Oak. Oak fox", "")], PASSAGE)
    seen = spark.createDataFrame([(1, 2, "S", 1, 1), (1, 3, "S", 1, 1), (1, 3, "T", 2, 2)], SEEN)
    slots = spark.createDataFrame([(1, 2, "T"), (1, 3, "U")], "story_id long, pos long, sub_event_id string")
    subs = spark.createDataFrame([(1, "T", "moon", "walk"), (1, "U", "red", "oak fox sky")],
                                 "story_id long, sub_event_id string, title string, summary string")
    r = Q.extract_summary(seen, passages, slots, subs)
    assert sorted((x["pos"], x["n_sentences"], x["summary"], x["relevance"]) for x in r.collect()) == [
        (2, 1, "A moon", 0.5), (3, 3, "Red fox | Old red oak | Oak fox", 0.5)]
    plan = r._jdf.queryExecution().executedPlan().toString().splitlines()
    made = [x for x in plan if "Generate " in x]
    assert made and not any("posexplode(" in x for x in made)
