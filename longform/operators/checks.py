"""Quality checks over generated corpora (Q1-Q25): rules the prompts state and no code enforces, as table jobs.

Per-character and per-story checks avoid windows over whole groups where a group can be large: "dead before" is a
``min`` aggregate joined back, previous mentions are equi-joins on a numbered sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longform.functions.graph import components
from longform.functions.records import ordered_text
from longform.functions.seq import block_of, running_max_before, running_min_after, seq_number, with_neighbour
from longform.operators.writing import event_adjacency
from longform.session import checkpoint_dir

SENTENCE_SPLIT = r"\. "
TOKEN_SPLIT = "[^a-z0-9]+"


def tokens(col: F.Column) -> F.Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(col), TOKEN_SPLIT), lambda t: t != ""))


def mentions(events: DataFrame) -> DataFrame:
    """Character mentions: one row per (story, event, position in the cast)."""
    return events.select("story_id", "event_id", "event_seq",
                         F.posexplode("characters").alias("cpos", "c")).select(
        "story_id", "event_id", "event_seq", "cpos", F.col("c.name").alias("name"), F.col("c.state").alias("state"))


def missing_elements(completeness: DataFrame) -> DataFrame:
    """Q1: tally of missing outline elements by round."""
    x = completeness.select("round", F.explode(F.col("missing")).alias("element"))
    return x.groupBy("round", "element").agg(F.count(F.lit(1)).alias("n"))


def character_coverage(required: DataFrame, events: DataFrame) -> DataFrame:
    """Q2: required characters of a story that no event mentions."""
    seen = mentions(events).select("story_id", "name").distinct()
    return required.join(seen, ["story_id", "name"], "left_anti")


def isolated_events(events: DataFrame, relations: DataFrame) -> DataFrame:
    """Q4: events with no neighbour at all."""
    adj = event_adjacency(relations).select("story_id", "event_id").distinct()
    return events.select("story_id", "event_id").join(adj, ["story_id", "event_id"], "left_anti")


def graph_components(events: DataFrame, relations: DataFrame) -> DataFrame:
    """Q4: connected parts of each story's graph: every event with the first event of its part and the part's size."""
    seq = events.select("story_id", "event_id", "event_seq")
    edges = relations.select("story_id", "source_event_id", "target_event_id")
    for side, name in (("source_event_id", "a"), ("target_event_id", "b")):
        edges = edges.join(seq.select("story_id", F.col("event_id").alias(side), F.col("event_seq").alias(name)),
                           ["story_id", side])
    parts = components(seq.withColumnRenamed("event_seq", "node"), edges, ["story_id"])
    sizes = parts.groupBy("story_id", "root").agg(F.count(F.lit(1)).alias("n_events"))
    return (parts.join(sizes, ["story_id", "root"]).join(seq.withColumnRenamed("event_seq", "node"), ["story_id", "node"])
            .select("story_id", "event_id", F.col("root").alias("first_seq"), "n_events"))


def dead_then_alive(events: DataFrame) -> DataFrame:
    """Q5: a character mentioned as not dead after an earlier event mentioned them dead."""
    m = mentions(events)
    first_dead = (m.where(F.col("state") == "dead").groupBy("story_id", "name")
                  .agg(F.min("event_seq").alias("dead_seq")))
    return (m.join(first_dead, ["story_id", "name"])
            .where((F.col("event_seq") > F.col("dead_seq")) & (F.col("state") != "dead"))
            .select("story_id", "name", "event_seq", "state", "dead_seq"))


def causal_order(events: DataFrame, relations: DataFrame) -> DataFrame:
    """Q6: causal edges whose cause comes after its effect in event order."""
    s = events.select("story_id", F.col("event_id").alias("source_event_id"), F.col("event_seq").alias("src_seq"))
    t = events.select("story_id", F.col("event_id").alias("target_event_id"), F.col("event_seq").alias("tgt_seq"))
    r = relations.where(F.col("type") == "causal").join(s, ["story_id", "source_event_id"]).join(
        t, ["story_id", "target_event_id"])
    return r.where(F.col("src_seq") > F.col("tgt_seq")).select("story_id", "rel_seq", "source_event_id",
                                                               "target_event_id", "src_seq", "tgt_seq")


def state_transitions(events: DataFrame) -> DataFrame:
    """Q7: a character's state differs from their previous mention's state."""
    m = seq_number(mentions(events), ["story_id", "name"], ["event_seq", "cpos"], "k",
                   block=[block_of("event_seq")])
    m = with_neighbour(m, ["story_id", "name"], "k", ["state", "event_seq"], step=-1, suffix="_prev")
    return m.where(F.col("state_prev").isNotNull() & (F.col("state") != F.col("state_prev"))).select(
        "story_id", "name", "event_seq", F.col("event_seq_prev").alias("prev_event_seq"),
        F.col("state_prev").alias("prev_state"), "state")


def score_range(events: DataFrame) -> DataFrame:
    """Q9: scores outside 0..1 (unpivoted)."""
    u = events.select("story_id", "event_id", F.expr(
        "stack(2, 'novelty_score', novelty_score, 'coherence_score', coherence_score) AS (score_name, score)"))
    return u.where((F.col("score") < 0) | (F.col("score") > 1))


def passage_score_range(passages: DataFrame) -> DataFrame:
    """Q9 for passages: relevance of the compressed context and confidence of the revision outside 0..1 (unpivoted)."""
    u = passages.select("story_id", "pos", F.expr(
        "stack(2, 'relevance_score', relevance_score, 'confidence', confidence) AS (score_name, score)"))
    return u.where((F.col("score") < 0) | (F.col("score") > 1))


def required_fields(events: DataFrame) -> DataFrame:
    """Q10: events with an empty time, location, goal, conflict or cast."""
    u = events.select("story_id", "event_id", F.expr(
        "stack(5, 'time', trim(time) = '', 'location', trim(location) = '', 'goal', trim(goal) = '', "
        "'conflict', trim(conflict) = '', 'characters', size(characters) = 0) AS (field, empty)"))
    return u.where(F.col("empty")).select("story_id", "event_id", "field")


def candidate_cap(candidates: DataFrame, k: int) -> DataFrame:
    """Q11: candidates per batch against ``k``."""
    return (candidates.groupBy("story_id", "round", "val_iter").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("over_cap", F.col("n") > k))


def duplicate_relations(relations: DataFrame) -> DataFrame:
    """Q12: the same (source, target, type) listed more than once."""
    return (relations.groupBy("story_id", "source_event_id", "target_event_id", "type")
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def one_verdict(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Q13: ids of a batch without exactly one verdict per candidate (full outer join of counts)."""
    keys = ["story_id", "round", "val_iter", "event_id"]
    c = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_candidates"))
    v = verdicts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_verdicts"))
    j = c.join(v, keys, "full").fillna(0, ["n_candidates", "n_verdicts"])
    return j.where((F.col("n_candidates") != F.col("n_verdicts")) | (F.col("n_verdicts") != 1))


def sub_event_count(events: DataFrame, sub_events: DataFrame, lo: int = 3, hi: int = 5) -> DataFrame:
    """Q14: events whose sub-event count is outside ``lo..hi``."""
    n = sub_events.groupBy("story_id", F.col("parent_event_id").alias("event_id")).agg(
        F.count(F.lit(1)).alias("n_sub_events"))
    j = events.select("story_id", "event_id").join(n, ["story_id", "event_id"], "left").fillna(0, ["n_sub_events"])
    return (j.where((F.col("n_sub_events") < lo) | (F.col("n_sub_events") > hi))
            .withColumn("verdict", F.when(F.col("n_sub_events") < lo, "too few").otherwise("too many")))


def sub_event_characters(sub_events: DataFrame, events: DataFrame) -> DataFrame:
    """Q15: sub-event characters the parent event does not list."""
    s = sub_events.select("story_id", "sub_event_id", "parent_event_id",
                          F.transform("characters", lambda c: c["name"]).alias("names"))
    e = events.select("story_id", F.col("event_id").alias("parent_event_id"),
                      F.transform("characters", lambda c: c["name"]).alias("parent_names"))
    j = s.join(e, ["story_id", "parent_event_id"])
    return j.select("story_id", "sub_event_id", F.explode(F.array_except("names", "parent_names")).alias("name"))


def plan_coverage(sub_events: DataFrame, slots: DataFrame) -> DataFrame:
    """Q16: sub-events in no chapter or in several, and chapter entries naming unknown sub-events."""
    n = slots.groupBy("story_id", "sub_event_id").agg(F.count(F.lit(1)).alias("n_slots"))
    j = sub_events.select("story_id", "sub_event_id", F.lit(True).alias("known")).join(
        n, ["story_id", "sub_event_id"], "full").fillna(0, ["n_slots"])
    status = (F.when(F.col("known").isNull(), "unknown").when(F.col("n_slots") == 0, "unplaced")
              .when(F.col("n_slots") > 1, "repeated"))
    return j.select("story_id", "sub_event_id", "n_slots", status.alias("status")).where(F.col("status").isNotNull())


def nonlinear_order(slots_with_seq: DataFrame) -> DataFrame:
    """Q17: flashbacks: a slot whose plan position is before the furthest plan position already read."""
    r = running_max_before(slots_with_seq, ["story_id"], "pos", "sub_seq", "prior_max")
    return r.where(F.col("sub_seq") < F.col("prior_max")).select("story_id", "pos", "sub_seq", "prior_max")


def order_jumps(slots_with_seq: DataFrame) -> DataFrame:
    """Q17, both ways: a slot is a flashback if an earlier slot reads a later plan position, and a flash-forward if a later
    slot reads an earlier one. Running extremes are taken in blocks, so no window holds a whole story."""
    r = running_max_before(slots_with_seq, ["story_id"], "pos", "sub_seq", "prior_max")
    r = running_min_after(r, ["story_id"], "pos", "sub_seq", "later_min")
    r = r.select("story_id", "pos", "sub_seq", F.coalesce(F.col("sub_seq") < F.col("prior_max"), F.lit(False)).alias(
        "flashback"), F.coalesce(F.col("sub_seq") > F.col("later_min"), F.lit(False)).alias("flash_forward"))
    return r.where(F.col("flashback") | F.col("flash_forward"))


def chapter_spread(chapters: DataFrame) -> DataFrame:
    """Q18: standard deviation, median and 90th percentile (interpolated) of a story's chapter sizes."""
    c = chapters.select("story_id", F.size("sub_event_ids").alias("size"))
    return c.groupBy("story_id").agg(
        F.count(F.lit(1)).alias("n_chapters"), F.round(F.stddev_pop("size"), 6).alias("stddev_size"),
        F.round(F.percentile("size", F.lit(0.5)), 6).alias("median_size"),
        F.round(F.percentile("size", F.lit(0.9)), 6).alias("p90_size"))


def chapter_sizes(chapters: DataFrame) -> DataFrame:
    """Q18: spread of chapter sizes per story."""
    c = chapters.select("story_id", F.size("sub_event_ids").alias("size"))
    return c.groupBy("story_id").agg(F.count(F.lit(1)).alias("n_chapters"), F.min("size").alias("min_size"),
                                     F.max("size").alias("max_size"), F.round(F.avg("size"), 6).alias("avg_size"))


def sentences(passages: DataFrame) -> DataFrame:
    """``(story_id, pos, sentence)``, one row per sentence of a passage."""
    s = passages.select("story_id", "pos", F.explode(F.split("raw_text", SENTENCE_SPLIT)).alias("sentence"))
    return s.withColumn("sentence", F.regexp_replace(F.trim("sentence"), r"\.$", ""))


def repeated_sentences(passages: DataFrame) -> DataFrame:
    """Q21: sentences that occur more than once within a passage."""
    return (sentences(passages).groupBy("story_id", "pos", "sentence").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def repeated_in_context(passages: DataFrame, siblings: DataFrame) -> DataFrame:
    """Q21: sentences of a passage that a passage visible to it holds already, with the number of such passages.

    ``siblings`` are the rows of W9. Sentences are joined by hash and compared as texts after that."""
    s = sentences(passages).distinct().withColumn("_h", F.xxhash64("sentence"))
    seen = siblings.where(F.col("visible_pos").isNotNull()).select("story_id", "pos", "visible_pos")
    held = seen.join(s.select("story_id", F.col("pos").alias("visible_pos"), F.col("sentence").alias("_held"), "_h"),
                     ["story_id", "visible_pos"])
    return (s.join(held, ["story_id", "pos", "_h"]).where(F.col("sentence") == F.col("_held"))
            .groupBy("story_id", "pos", "sentence").agg(F.count(F.lit(1)).alias("n_earlier")))


NAME_SPLIT = r"[^\p{L}\p{N}]+"
NAME_WORDS = 5


def _name_words(text: F.Column) -> F.Column:
    return F.filter(F.split(text, NAME_SPLIT), lambda w: w != "")


def _word_runs(said: F.Column, shortest: int, longest: int) -> F.Column:
    """The distinct runs of ``shortest`` to ``longest`` neighbouring words of a list, joined by blanks."""
    def from_word(i: F.Column) -> F.Column:
        most = F.least(F.lit(longest), F.size(said) - i)
        return F.when(most >= shortest, F.transform(F.sequence(F.lit(shortest), most),
                                                    lambda n: F.array_join(F.slice(said, i + 1, n), " ")))
    return F.array_distinct(F.flatten(F.filter(F.transform(said, lambda w, i: from_word(i)), lambda x: x.isNotNull())))


def wrong_names(passages: DataFrame, sub_events: DataFrame, events: DataFrame) -> DataFrame:
    """Q22: a character of the story named in a passage but not listed for the passage's sub-event.

    Names of any shape: the distinct word n-grams of a passage, up to ``NAME_WORDS`` words, are looked up among the first
    words of the names of the story's cast, and the whole of longer names is compared after that. A passage has far more
    n-grams than a story has names, so the names of a task's stories are hashed and the n-grams pass by unsorted."""
    cast = mentions(events).select("story_id", "name").distinct().withColumn("_words", _name_words(F.col("name")))
    cast = cast.where(F.size("_words") > 0).withColumn("_gram", F.array_join(F.slice("_words", 1, NAME_WORDS), " "))
    long_ = F.size("_words") > NAME_WORDS
    short_cast = cast.where(~long_).select("story_id", "_gram", "name")
    long_cast = cast.where(long_).select("story_id", "_gram", "name", F.array_join("_words", " ").alias("_whole"))
    p = passages.select("story_id", "pos", "sub_event_id", _name_words(F.col("raw_text")).alias("_said"))
    key = ["story_id", "pos", "sub_event_id", "name"]
    grams = p.select("story_id", "pos", "sub_event_id", F.explode(_word_runs(F.col("_said"), 1, NAME_WORDS)).alias("_gram"))
    short = grams.join(short_cast.hint("shuffle_hash"), ["story_id", "_gram"]).select(*key)
    # only passages of stories that have such a name
    with_long = p.join(long_cast.select("story_id").distinct().hint("shuffle_hash"), "story_id", "left_semi")
    starts = with_long.select("story_id", "pos", "sub_event_id", F.array_join("_said", " ").alias("_text"),
                              F.explode(_word_runs(F.col("_said"), NAME_WORDS, NAME_WORDS)).alias("_gram"))
    blank = F.lit(" ")
    whole = starts.join(long_cast.hint("shuffle_hash"), ["story_id", "_gram"]).where(
        F.contains(F.concat(blank, "_text", blank), F.concat(blank, "_whole", blank))).select(*key)
    named = short.unionByName(whole).distinct()
    listed = sub_events.select("story_id", "sub_event_id", F.explode(
        F.transform("characters", lambda c: c["name"])).alias("name")).distinct()
    return named.join(listed, ["story_id", "sub_event_id", "name"], "left_anti")


def edit_size(passages: DataFrame) -> DataFrame:
    """Q23: word-set difference between raw and revised text, where a revision exists."""
    p = passages.where(F.col("revised_text") != "").select(
        "story_id", "pos", tokens(F.col("raw_text")).alias("a"), tokens(F.col("revised_text")).alias("b"))
    return p.select("story_id", "pos", F.size(F.array_except("a", "b")).cast("long").alias("n_removed"),
                    F.size(F.array_except("b", "a")).cast("long").alias("n_added"))


def issue_tally(passages: DataFrame) -> DataFrame:
    """Q24: reviewer issues by kind."""
    return (passages.select(F.explode("issues").alias("issue")).groupBy("issue")
            .agg(F.count(F.lit(1)).alias("n")))


def low_confidence(passages: DataFrame, threshold: float) -> DataFrame:
    """Q24: revision results below a confidence threshold (the review queue)."""
    return passages.where(F.col("confidence") < threshold).select("story_id", "pos", "sub_event_id", "confidence")


def realization(passages: DataFrame, sub_events: DataFrame) -> DataFrame:
    """Q25: share of the sub-event summary's words that the passage uses."""
    s = sub_events.select("story_id", "sub_event_id", tokens(F.col("summary")).alias("want"))
    p = passages.select("story_id", "pos", "sub_event_id", tokens(F.col("raw_text")).alias("have"))
    j = p.join(s, ["story_id", "sub_event_id"])
    return j.select("story_id", "pos", F.round(F.size(F.array_intersect("want", "have")) / F.size("want"), 6)
                    .alias("coverage"))


def near_duplicate_events(events: DataFrame, min_num: int = 8, min_den: int = 10) -> DataFrame:
    """Q8: pairs of events of a story whose word sets have a Jaccard similarity above ``min_num / min_den``.

    Exact prefix filter: a pair that similar shares one of the ``n - ceil(t * n) + 1`` rarest words of each, so only
    those are joined; the share is then counted on the whole sets, in integers.
    """
    words = tokens(F.concat_ws(" ", "title", "summary", "location", "goal", "conflict"))
    e = events.select("story_id", "event_seq", "event_id", words.alias("words"))
    w = e.select("story_id", "event_seq", F.explode("words").alias("word"))
    df = w.groupBy("story_id", "word").agg(F.count(F.lit(1)).alias("df"))
    ranked = (w.join(df, ["story_id", "word"]).groupBy("story_id", "event_seq")
              .agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("r")))
    n = F.size("r")
    prefix = F.slice("r", 1, n - F.floor((n * min_num + min_den - 1) / min_den).cast("int") + 1)
    p = ranked.select("story_id", "event_seq", F.explode(prefix).alias("x")).select("story_id", "event_seq", "x.word")
    pairs = (p.withColumnRenamed("event_seq", "seq_a").join(p.withColumnRenamed("event_seq", "seq_b"),
                                                            ["story_id", "word"])
             .where("seq_a < seq_b").select("story_id", "seq_a", "seq_b").distinct())
    a = e.select("story_id", F.col("event_seq").alias("seq_a"), F.col("event_id").alias("event_a"),
                 F.col("words").alias("wa"))
    b = e.select("story_id", F.col("event_seq").alias("seq_b"), F.col("event_id").alias("event_b"),
                 F.col("words").alias("wb"))
    both = pairs.join(a, ["story_id", "seq_a"]).join(b, ["story_id", "seq_b"]).withColumn(
        "shared", F.size(F.array_intersect("wa", "wb")).cast("long"))
    both = both.withColumn("words", F.size("wa").cast("long") + F.size("wb").cast("long") - F.col("shared"))
    return (both.where(F.col("shared") * min_den > F.col("words") * min_num)
            .select("story_id", "event_a", "event_b", "shared", "words"))


def _history(siblings: DataFrame, passages: DataFrame) -> DataFrame:
    """Raw texts that a slot can look back on: the visible passage of each sibling."""
    p = passages.select("story_id", F.col("pos").alias("visible_pos"), F.col("raw_text").alias("history"))
    return (siblings.where(F.col("visible_pos").isNotNull()).select("story_id", "pos", "sibling_seq", "visible_pos")
            .join(p, ["story_id", "visible_pos"]))


def extract_summary(siblings: DataFrame, passages: DataFrame, slots: DataFrame, sub_events: DataFrame,
                    k: int = 3) -> DataFrame:
    """Q19: for each slot with a history, its ``k`` sentences that share most words with the slot's sub-event, in
    reading order, and the best sentence's share of the sub-event's words (the report's limit is the feature)."""
    want = (slots.select("story_id", "pos", "sub_event_id").join(sub_events, ["story_id", "sub_event_id"])
            .select("story_id", "pos", tokens(F.concat_ws(" ", "title", "summary")).alias("want")))
    # sentences are counted where their text lies and carry the number of wanted words only
    told = F.transform(F.split("history", SENTENCE_SPLIT), lambda x, i: F.struct(
        i.alias("idx"), x.alias("sentence"), F.size(F.array_intersect(tokens(x), "want")).alias("shared")))
    s = _history(siblings, passages).join(want, ["story_id", "pos"]).select(
        "story_id", "pos", "sibling_seq", F.size("want").alias("n_want"), F.inline(F.filter(told, lambda x: x["shared"] > 0)))
    order = Window.partitionBy("story_id", "pos").orderBy(F.desc("shared"), "sibling_seq", "idx")
    top = s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.groupBy("story_id", "pos").agg(
        F.count(F.lit(1)).alias("n_sentences"),
        ordered_text(F.col("sentence"), F.struct("sibling_seq", "idx"), " | ").alias("summary"),
        F.max(F.col("shared") / F.col("n_want")).alias("relevance"))


def summary_new_facts(siblings: DataFrame, passages: DataFrame) -> DataFrame:
    """Q20: how many words of a slot's summary its history does not hold (all of them without a history)."""
    words = passages.select("story_id", "pos", tokens(F.col("summary_text")).alias("_words")).where(F.size("_words") > 0)
    said = words.groupBy("story_id", "pos").agg(F.flatten(F.collect_list("_words")).alias("_said"))
    # each visible text is asked for the summary's words only: no row for each word of a history
    held = (_history(siblings, passages).join(said, ["story_id", "pos"])
            .select("story_id", "pos", F.array_intersect("_said", tokens(F.col("history"))).alias("_held"))
            .where(F.size("_held") > 0).groupBy("story_id", "pos").agg(F.flatten(F.collect_list("_held")).alias("_held")))
    new = F.size("_said") - F.size(F.filter("_said", lambda w: F.array_contains("_held", w)))
    g = said.join(held, ["story_id", "pos"], "left").select(
        "story_id", "pos", F.size("_said").cast("long").alias("n_words"),
        F.when(F.col("_held").isNull(), F.size("_said")).otherwise(new).cast("long").alias("n_new"))
    return g.withColumn("new_share", F.col("n_new") / F.col("n_words"))


def causal_chain(relations: DataFrame, events: DataFrame) -> DataFrame:
    """Q3: the longest chain of causal links of each story that has one, over links that point forward in the outline.

    Round ``n`` holds the events that some chain of ``n`` links ends in, so rows stay within the events and no path is
    listed. Rounds go on until none is left (links point forward, so they end) and are written to the shared checkpoint
    folder; the driver sees whether a round is empty.
    """
    checkpoint_dir(events.sparkSession)
    seq = events.select("story_id", "event_id", "event_seq")
    links = (relations.where(F.col("type") == "causal")
             .join(seq.select("story_id", F.col("event_id").alias("source_event_id"), F.col("event_seq").alias("at")),
                   ["story_id", "source_event_id"])
             .join(seq.select("story_id", F.col("event_id").alias("target_event_id"), F.col("event_seq").alias("to")),
                   ["story_id", "target_event_id"])
             .where(F.col("at") < F.col("to")).select("story_id", "at", "to").distinct().checkpoint())
    ends = links.select("story_id", "at").distinct()
    best = links.select("story_id").distinct().withColumn("n_links", F.lit(0).cast("long"))
    n = 0
    while True:
        ends = ends.join(links, ["story_id", "at"]).select("story_id", F.col("to").alias("at")).distinct().checkpoint()
        if ends.isEmpty():
            return best.withColumn("n_events", F.col("n_links") + 1)
        n += 1
        best = (best.unionByName(ends.select("story_id").distinct().withColumn("n_links", F.lit(n).cast("long")))
                .groupBy("story_id").agg(F.max("n_links").alias("n_links")).checkpoint())
