"""Prompt request builders (T1-T10): join a stage's inputs by story, aggregate lists in order, fill a template.

A template is a tuple of pieces: plain text, or ``{slot}`` names filled from columns. The same template renders as
a Spark column (``concat``) and as SQL text, so the request table is reproducible outside Spark. Each request
carries ``prompt_hash = sha2(prompt, 256)``, the ledger key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longform.functions.records import event_json, ordered_text, sub_event_json

# Request texts: one task sentence, then the inputs a model needs for it, each under a bracketed name.
TEMPLATES = {
    "completeness": ("Does this outline tell its story from start to end? Answer with one JSON object.\n"
                     "[story idea] {premise}\n[outline, one event a line]\n{events}\n"),
    "seed": ("Continue this outline with at most {k} new events, as a JSON list.\n[story idea] {premise}\n"
             "[why it is unfinished] {reason}\n[what is still needed] {missing}\n[outline, one event a line]\n{events}\n"),
    "validate": ("Judge for each proposal whether it fits the outline. Answer with a JSON list of verdicts.\n"
                 "[story idea] {premise}\n[outline, one event a line]\n{events}\n[proposals]\n{candidates}\n"),
    "revise": ("Rework the proposals that were turned down, following the remarks. Answer with a JSON list of events.\n"
               "[story idea] {premise}\n[remarks]\n{feedback}\n[proposals]\n{candidates}\n"
               "[outline, one event a line]\n{events}\n"),
    "relations": ("Which events depend on each other, and how? Answer with a JSON list of links.\n"
                  "[outline, one event a line]\n{events}\n[story idea] {premise}\n"),
    "subevents": ("Break the event {target} into scenes. Answer with a JSON list of scenes.\n"
                  "[graph of the story] {graph}\n[story idea] {premise}\n"),
    "weave": ("Arrange all scenes in chapters, in the order of reading. Answer with a JSON list of chapters.\n"
              "[scenes, one a line]\n{sub_events}\n[graph of the story] {graph}\n[story idea] {premise}\n"),
    "compress": ("Sum up what the next scene has to know of the text so far. Answer with one JSON object.\n"
                 "[next scene] {sub_event}\n[text so far]\n{history}\n[story idea] {premise}\n"),
    "write": ("Write the scene as prose and nothing else.\n[scene] {sub_event}\n[it belongs to] {chapter}\n"
              "[after it comes] {next_chapter}\n[known so far] {summary}\n[story idea] {premise}\n"),
    "revise_passage": ("Check the draft against the plan and mend it. Answer with one JSON object.\n[draft]\n{raw_text}\n"
                       "[scene] {sub_event}\n[known so far] {summary}\n[graph of the story] {graph}\n"
                       "[story idea] {premise}\n"),
}

_SLOT = re.compile(r"\{([a-z_]+)\}")


def pieces(stage: str) -> list[tuple[str, str]]:
    """Template as [("text", s) | ("slot", name)]."""
    out, pos, t = [], 0, TEMPLATES[stage]
    for m in _SLOT.finditer(t):
        if m.start() > pos:
            out.append(("text", t[pos:m.start()]))
        out.append(("slot", m.group(1)))
        pos = m.end()
    if pos < len(t):
        out.append(("text", t[pos:]))
    return out


def render(stage: str, slots: dict[str, Column]) -> Column:
    return F.concat(*[F.lit(v) if k == "text" else F.coalesce(slots[v].cast("string"), F.lit(""))
                      for k, v in pieces(stage)])


def render_sql(stage: str, slots: dict[str, str]) -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return "concat(" + ", ".join(lit(v) if k == "text" else f"coalesce(CAST({slots[v]} AS VARCHAR), '')"
                                 for k, v in pieces(stage)) + ")"


def with_hash(df: DataFrame, stage: str) -> DataFrame:
    return df.withColumn("stage", F.lit(stage)).withColumn("prompt_hash", F.sha2(F.col("prompt"), 256))


def events_text(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One JSON line per accepted event, in event order, per story (or per ``keys``)."""
    keys = keys or ["story_id"]
    return events.groupBy(*keys).agg(ordered_text(event_json(), F.col("event_seq"), "\n").alias("events"))


def req_completeness(stories: DataFrame, events: DataFrame) -> DataFrame:
    """Premise and the events so far (empty for a story with none yet)."""
    s = stories.join(events_text(events), "story_id", "left")
    p = render("completeness", {"premise": F.col("premise"), "events": F.col("events")})
    return with_hash(s.select("story_id", p.alias("prompt")), "completeness")


def req_validate(stories: DataFrame, events: DataFrame, candidates: DataFrame, batch: list[str]) -> DataFrame:
    """Premise, events so far, the batch's candidates; the two lists are aggregated apart, then joined."""
    cand = candidates.groupBy(*batch).agg(ordered_text(event_json(), F.col("pos"), "\n").alias("candidates"))
    s = cand.join(stories, "story_id").join(events_text(events), "story_id", "left")
    p = render("validate", {"premise": F.col("premise"), "events": F.col("events"),
                            "candidates": F.col("candidates")})
    return with_hash(s.select(*batch, p.alias("prompt")), "validate")


def req_completeness_rounds(stories: DataFrame, accepted: DataFrame, rounds: DataFrame) -> DataFrame:
    """T1 as it is asked: one request for each round ``(story_id, round)``, over the events accepted in earlier rounds.
    ``accepted`` carries ``round`` and ``val_iter``."""
    text = _prefix_text(rounds.select("story_id", "round").distinct(), accepted, F.col("_round") < F.col("round"))
    p = render("completeness", {"premise": F.col("premise"), "events": F.col("events")})
    return with_hash(text.join(stories, "story_id").select("story_id", "round", p.alias("prompt")), "completeness")


def req_validate_rounds(stories: DataFrame, accepted: DataFrame, candidates: DataFrame) -> DataFrame:
    """T3 as it is asked: a batch's candidates against the events accepted in earlier rounds and earlier passes of the
    same round. ``accepted`` as in ``req_completeness_rounds``."""
    batch = ["story_id", "round", "val_iter"]
    cand = candidates.groupBy(*batch).agg(ordered_text(event_json(), F.col("pos"), "\n").alias("candidates"))
    earlier = (F.col("_round") < F.col("round")) | ((F.col("_round") == F.col("round"))
                                                    & (F.col("_val_iter") < F.col("val_iter")))
    text = _prefix_text(candidates.select(*batch).distinct(), accepted, earlier)
    s = cand.join(text, batch).join(stories, "story_id")
    p = render("validate", {"premise": F.col("premise"), "events": F.col("events"),
                            "candidates": F.col("candidates")})
    return with_hash(s.select(*batch, p.alias("prompt")), "validate")


def req_relations(stories: DataFrame, events: DataFrame) -> DataFrame:
    """T5: premise and all accepted events."""
    s = stories.join(events_text(events), "story_id", "left")
    p = render("relations", {"premise": F.col("premise"), "events": F.col("events")})
    return with_hash(s.select("story_id", p.alias("prompt")), "relations")


def req_subevents(stories: DataFrame, graph_json: DataFrame, events: DataFrame) -> DataFrame:
    """One request per event; the graph text is kept once per story and joined in last."""
    s = events.select("story_id", "event_seq", F.col("event_id").alias("target_event_id"))
    s = s.join(stories, "story_id").join(graph_json, "story_id")
    p = render("subevents", {"premise": F.col("premise"), "graph": F.col("graph_json"),
                             "target": F.col("target_event_id")})
    return with_hash(s.select("story_id", "event_seq", "target_event_id", p.alias("prompt")), "subevents")


def req_weave(stories: DataFrame, graph_json: DataFrame, sub_events: DataFrame) -> DataFrame:
    """Premise, graph and all sub-events in plan order."""
    se = sub_events.groupBy("story_id").agg(ordered_text(sub_event_json(), F.col("sub_seq"), "\n").alias("subs"))
    s = stories.join(graph_json, "story_id").join(se, "story_id", "left")
    p = render("weave", {"premise": F.col("premise"), "graph": F.col("graph_json"), "sub_events": F.col("subs")})
    return with_hash(s.select("story_id", p.alias("prompt")), "weave")


def req_compress(stories: DataFrame, contexts: DataFrame, sub_events: DataFrame) -> DataFrame:
    """Premise, the slot's context (W10) and its sub-event. Contexts are long: they pass by tables of the others' rows,
    unsorted."""
    se = sub_events.select("story_id", "sub_event_id", sub_event_json().alias("sub_json"))
    s = contexts.join(se.hint("shuffle_hash"), ["story_id", "sub_event_id"]).join(stories.hint("shuffle_hash"), "story_id")
    p = render("compress", {"premise": F.col("premise"), "history": F.col("context"),
                            "sub_event": F.col("sub_json")})
    return with_hash(s.select("story_id", "pos", p.alias("prompt")), "compress")


def req_write(stories: DataFrame, slots: DataFrame, summaries: DataFrame, titles: DataFrame,
              sub_events: DataFrame) -> DataFrame:
    """Premise, compressed summary (W12), chapter title, next chapter title (W11), sub-event."""
    se = sub_events.select("story_id", "sub_event_id", sub_event_json().alias("sub_json"))
    s = (slots.join(se, ["story_id", "sub_event_id"]).join(summaries, ["story_id", "pos"])
         .join(titles.select("story_id", "chapter_pos", F.col("title").alias("chapter_title"), "next_title"),
               ["story_id", "chapter_pos"]).join(stories, "story_id"))
    p = render("write", {"premise": F.col("premise"), "summary": F.col("summary_text"),
                         "chapter": F.col("chapter_title"), "next_chapter": F.col("next_title"),
                         "sub_event": F.col("sub_json")})
    return with_hash(s.select("story_id", "pos", p.alias("prompt")), "write")


def _prefix_text(batches: DataFrame, events: DataFrame, before) -> DataFrame:
    """``batches`` with ``events``: the JSON lines of their story's accepted events for which ``before`` holds.

    ``batches`` are the distinct request keys. The accepted prefix is part of every request by definition, so the
    join emits as many rows as the requests have lines.
    """
    keys = batches.columns
    e = events.select("story_id", F.col("event_seq").alias("_seq"), F.col("round").alias("_round"),
                      F.col("val_iter").alias("_val_iter"), event_json().alias("_json"))
    text = (batches.join(e, "story_id").where(before)
            .groupBy(*keys).agg(ordered_text(F.col("_json"), F.col("_seq"), "\n").alias("events")))
    return batches.join(text, keys, "left")


def req_seed(stories: DataFrame, accepted: DataFrame, completeness: DataFrame, k: int, prefix: bool = True) -> DataFrame:
    """One request for each round whose outline is still open: the events accepted in earlier rounds, why it is
    open and what is missing. ``accepted`` carries ``round`` and ``val_iter``; without ``prefix`` all of it precedes the
    requests (a run that is at that round)."""
    open_ = completeness.where(~F.col("complete")).select("story_id", "round", "reason", "missing_elements")
    if prefix:
        text = _prefix_text(open_.select("story_id", "round").distinct(), accepted, F.col("_round") < F.col("round"))
        s = open_.join(text, ["story_id", "round"]).join(stories, "story_id")
    else:
        s = open_.join(events_text(accepted), "story_id", "left").join(stories, "story_id")
    p = render("seed", {"premise": F.col("premise"), "events": F.col("events"), "reason": F.col("reason"),
                        "missing": F.col("missing_elements"), "k": F.lit(k)})
    return with_hash(s.select("story_id", "round", p.alias("prompt")), "seed")


def req_revise(stories: DataFrame, accepted: DataFrame, rejected: DataFrame, max_val: int,
               prefix: bool = True) -> DataFrame:
    """T4: one request for each batch with rejected candidates (O9 rows, whole records), with the remarks and the events
    accepted up to and in that pass. The last pass asks for none: its revision would never be validated. ``prefix`` as in
    ``req_seed``."""
    batch = ["story_id", "round", "val_iter"]
    todo = rejected.where(F.col("val_iter") + 1 < max_val)
    remark = F.concat_ws(": ", "event_id", "suggestion")
    lists = todo.groupBy(*batch).agg(ordered_text(event_json(), F.col("first_pos"), "\n").alias("candidates"),
                                     ordered_text(remark, F.col("first_pos"), "\n").alias("feedback"))
    upto = (F.col("_round") < F.col("round")) | ((F.col("_round") == F.col("round"))
                                                 & (F.col("_val_iter") <= F.col("val_iter")))
    text = _prefix_text(lists.select(*batch), accepted, upto) if prefix else events_text(accepted)
    s = lists.join(text, batch if prefix else "story_id", "left").join(stories, "story_id")
    p = render("revise", {"premise": F.col("premise"), "events": F.col("events"), "feedback": F.col("feedback"),
                          "candidates": F.col("candidates")})
    return with_hash(s.select(*batch, p.alias("prompt")), "revise")


def req_revise_passage(stories: DataFrame, graph_json: DataFrame, passages: DataFrame,
                       sub_events: DataFrame) -> DataFrame:
    """Draft, scene, summary, graph and premise of each written slot; the graph is kept once per story and joined
    in last."""
    se = sub_events.select("story_id", "sub_event_id", sub_event_json().alias("sub_json"))
    s = (passages.select("story_id", "pos", "sub_event_id", "raw_text", "summary_text")
         .join(se, ["story_id", "sub_event_id"]).join(stories, "story_id").join(graph_json, "story_id"))
    p = render("revise_passage", {"premise": F.col("premise"), "graph": F.col("graph_json"),
                                  "sub_event": F.col("sub_json"), "summary": F.col("summary_text"),
                                  "raw_text": F.col("raw_text")})
    return with_hash(s.select("story_id", "pos", p.alias("prompt")), "revise_passage")
