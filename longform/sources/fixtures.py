"""Fixture views F1-F10: story data derived from the driver's star schema, so its size grows with the tables.

customer -> orders -> lineitem stands for story -> event -> sub-event. Ids collide on purpose (order key modulo 7),
order status gives verdicts (F valid, O invalid, P not validated), ship dates give chapters. Every view keeps all
rows of its inputs; attribute conditions (status, priority, quantity) only decide which rows play which part.
The same views are written in SQL for the DuckDB oracle (``longform.oracle``).
"""

from __future__ import annotations

from functools import cached_property, wraps

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longform.functions.records import ordered_list
from longform.functions.seq import window_number as seq_number
from longform.functions.seq import with_neighbour
from longform.sources.tables import table, table_bytes

# Files of orders and lineitem for each part that stories are dealt to: a task sorts its stories' texts (a hundred times their
# files at most, all contexts of all slots) in its memory at every size of the tables.
PART_BYTES = 2 << 20


def shared(fn):
    """A fixture view referenced by many queries of a session: persisted (memory, then disk) on first use, so
    one query plan and the next reuse it instead of re-deriving it. Lost blocks are recomputed from lineage.
    Only keys and numbers are persisted, dealt by story; views render their texts from them where they are read."""
    @cached_property
    @wraps(fn)
    def prop(self):
        return fn(self).persist(StorageLevel.MEMORY_AND_DISK)
    return prop


def by_story(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` dealt by story, so that windows and joins on a story and more columns need no further shuffle."""
    return df.repartition(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "story_id")


def by_order(li: DataFrame) -> DataFrame:
    return li.repartition(int(li.sparkSession.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")


def _event_key(order: str) -> F.Column:
    return F.concat(F.lit("E"), F.col(order).cast("string"))


def _supplier(key: F.Column) -> F.Column:
    return F.concat(F.lit("Supplier "), key.cast("string"))


def _state(flag: str) -> F.Column:
    return (F.when(F.col(flag) == "R", F.lit("dead")).when(F.col(flag) == "A", F.lit("wounded"))
            .otherwise(F.lit("healthy")))


class Fixtures:
    """Lazily built fixture DataFrames for one ``sf_dir``; numbering sub-events and passages runs a check of key sizes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def parts(self) -> int:
        """Parts of the views dealt by story, the same for all of them."""
        size = sum(table_bytes(self.spark, self.sf_dir, t) for t in ("orders", "lineitem"))
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    def by_story(self, df: DataFrame) -> DataFrame:
        return by_story(df, self.parts)

    # F1
    @shared
    def stories(self) -> DataFrame:
        c = self.t("customer")
        return c.select(F.col("c_custkey").alias("story_id"),
                        F.concat("c_name", F.lit(" in "), "c_mktsegment").alias("premise"))

    # F2
    @shared
    def order_keys(self) -> DataFrame:
        o = self.t("orders").select(F.col("o_custkey").alias("story_id"), "o_orderkey", "o_orderstatus", "o_orderdate",
                                    "o_orderpriority")
        return seq_number(self.by_story(o), ["story_id"], ["o_orderdate", "o_orderkey"], "event_seq")

    @cached_property
    def orders(self) -> DataFrame:
        return self.order_keys.select(
            "story_id", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority",
            _event_key("o_orderkey").alias("event_key"),
            F.concat(F.lit("E"), (F.col("o_orderkey") % 7).cast("string")).alias("event_id"), "event_seq")

    @cached_property
    def order_lines(self) -> DataFrame:
        """Lines of each order as numbers and flags, in line order."""
        li = self.t("lineitem")
        line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_linestatus").alias("role"),
                        _state("l_returnflag").alias("state"))
        return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("_lines"))

    @cached_property
    def order_detail(self) -> DataFrame:
        """What an order's Event record is made of."""
        o = self.t("orders").select(F.col("o_orderkey").alias("_key"), F.col("o_orderpriority").alias("_priority"),
                                    F.col("o_custkey").alias("_custkey"), F.col("o_orderdate").alias("_date"),
                                    F.col("o_orderstatus").alias("_status"))
        li = self.order_lines
        return o.join(li, o["_key"] == li["l_orderkey"], "left").drop("l_orderkey")

    @staticmethod
    def _event_fields() -> list[F.Column]:
        """Event record fields (title, summary, time, place, cast, goal, conflict, scores) from ``order_detail`` columns; the
        cast are the suppliers of the lines."""
        cast = F.transform("_lines", lambda x: F.struct(_supplier(x["l_suppkey"]).alias("name"), x["role"].alias("role"),
                                                        x["state"].alias("state")))
        empty_cast = F.array().cast("array<struct<name:string,role:string,state:string>>")
        key = F.col("_key").cast("string")
        return [
            F.col("_priority").alias("title"),
            F.concat(F.lit("Order "), key, F.lit(" placed by customer "), F.col("_custkey").cast("string")).alias("summary"),
            F.col("_date").cast("date").cast("string").alias("time"),
            F.when(F.col("_key") % 13 == 0, F.lit(""))
             .otherwise(F.concat(F.lit("Port "), (F.col("_key") % 9).cast("string"))).alias("location"),
            F.coalesce(cast, empty_cast).alias("characters"),
            F.concat(F.lit("Deliver order "), key).alias("goal"),
            F.when(F.col("_key") % 17 == 0, F.lit(""))
             .when(F.col("_status") == "F", F.lit("none"))
             .when(F.col("_status") == "O", F.lit("delay")).otherwise(F.lit("dispute")).alias("conflict"),
            ((F.col("_key") % 101).cast("double") / 100).alias("novelty_score"),
            ((F.col("_key") % 113).cast("double") / 100).alias("coherence_score")]

    @cached_property
    def event_detail(self) -> DataFrame:
        """Full Event record fields of every order."""
        return self.order_detail.select(F.col("_key").alias("o_orderkey"), *self._event_fields())

    @cached_property
    def candidates(self) -> DataFrame:
        """Seed candidates (val_iter 0): three per round in event order; revised ones (val_iter 1) for urgent,
        high and medium priority orders still open."""
        o = self.orders
        base = o.select("story_id", F.floor((F.col("event_seq") - 1) / 3).cast("int").alias("round"),
                        F.lit(0).alias("val_iter"), ((F.col("event_seq") - 1) % 3).cast("int").alias("pos"),
                        "event_id", "event_key", "o_orderkey")
        rev = (o.where((F.col("o_orderstatus") == "O")
                       & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
               .select("story_id", F.floor((F.col("event_seq") - 1) / 3).cast("int").alias("round"),
                       F.lit(1).alias("val_iter"), ((F.col("event_seq") - 1) % 3).cast("int").alias("pos"),
                       "event_id", "event_key", "o_orderkey"))
        return base.unionByName(rev)

    @shared
    def candidate_keys(self) -> DataFrame:
        c = self.candidates.select("story_id", "round", "val_iter", "pos", "o_orderkey")
        return self.by_story(c.join(self.order_detail, F.col("o_orderkey") == F.col("_key")))

    @cached_property
    def candidate_records(self) -> DataFrame:
        """Candidates with full Event fields; revised candidates carry a marked title."""
        c = self.candidate_keys.select(
            "o_orderkey", "story_id", "round", "val_iter", "pos",
            F.concat(F.lit("E"), (F.col("o_orderkey") % 7).cast("string")).alias("event_id"),
            _event_key("o_orderkey").alias("event_key"), *self._event_fields())
        return c.withColumn("title", F.when(F.col("val_iter") > 0, F.concat("title", F.lit(" (revised)")))
                            .otherwise(F.col("title")))

    # F3
    @cached_property
    def verdicts(self) -> DataFrame:
        o = self.orders
        rnd = F.floor((F.col("event_seq") - 1) / 3).cast("int").alias("round")
        pos = ((F.col("event_seq") - 1) % 3).cast("int").alias("pos")
        v0 = o.where(F.col("o_orderstatus") != "P").select(
            "story_id", rnd, F.lit(0).alias("val_iter"), pos, "event_id",
            (F.col("o_orderstatus") == "F").alias("valid"))
        v1 = (o.where((F.col("o_orderstatus") == "O")
                      & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
              .select("story_id", rnd, F.lit(1).alias("val_iter"), pos, "event_id",
                      (F.col("o_orderkey") % 3 != 0).alias("valid")))
        v = v0.unionByName(v1)
        return v.withColumn("suggestion", F.when(F.col("valid"), F.lit(""))
                            .otherwise(F.concat(F.lit("rework "), F.col("event_id"))))

    @shared
    def completeness(self) -> DataFrame:
        c = self.candidates.select("story_id", "round").distinct()
        complete = ((F.col("story_id") * 7919 + F.col("round") * 31) % 11 == 0)
        missing = (F.when((F.col("story_id") + F.col("round")) % 4 == 0, F.lit(""))
                   .when((F.col("story_id") + F.col("round")) % 4 == 1, F.lit("climax"))
                   .when((F.col("story_id") + F.col("round")) % 4 == 2, F.lit("climax,resolution"))
                   .otherwise(F.lit("character arcs")))
        return c.select("story_id", "round", complete.alias("complete"),
                        F.when(complete, F.lit("arc closed"))
                         .otherwise(F.concat(F.lit("round "), F.col("round").cast("string"), F.lit(" open")))
                         .alias("reason"),
                        missing.alias("missing_elements"))

    # F4
    @cached_property
    def relations_base(self) -> DataFrame:
        """Edges between successive events of a story that ship the same part (a chain per part, not all pairs)."""
        o = self.order_keys.select("story_id", "o_orderkey", "event_seq", "o_orderpriority")
        li = by_order(self.t("lineitem").select("l_orderkey", "l_partkey")).distinct()
        pe = self.by_story(o.join(li, o.o_orderkey == li.l_orderkey).select(
            "story_id", "l_partkey", "o_orderkey", "event_seq", "o_orderpriority"))
        pe = seq_number(pe, ["story_id", "l_partkey"], ["event_seq"], "k")
        nxt = with_neighbour(pe, ["story_id", "l_partkey"], "k", ["o_orderkey", "event_seq"], step=1)
        e = nxt.where(F.col("o_orderkey_next").isNotNull())
        return e.select(
            "story_id",
            F.when(F.col("l_partkey") % 2 == 0, F.lit("causal")).otherwise(F.lit("temporal")).alias("type"),
            _event_key("o_orderkey").alias("source_event_id"), _event_key("o_orderkey_next").alias("target_event_id"),
            F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("rationale"),
            F.col("event_seq").alias("src_seq"), F.col("event_seq_next").alias("tgt_seq"), "l_partkey",
            F.col("o_orderpriority").alias("src_priority"))

    @shared
    def relations(self) -> DataFrame:
        """Model edge list: base chain, urgent sources repeated, high-priority sources also reversed, and a
        self-loop on the first event of low-priority stories; ``rel_seq`` is list order."""
        b, priority = self.relations_base, F.col("src_priority")

        def edge(source: str, target: str, variant: int) -> F.Column:
            return F.struct(F.col(source).alias("source_event_id"), F.col(target).alias("target_event_id"),
                            F.lit(variant).alias("variant"))

        # one pass over the chain, not one for each variant
        own, back = ("source_event_id", "target_event_id"), ("target_event_id", "source_event_id")
        r = b.select("story_id", "type", "rationale", "src_seq", "tgt_seq", "l_partkey", F.explode(F.array(
            edge(*own, 0), F.when(priority == "1-URGENT", edge(*own, 1)),
            F.when(priority == "2-HIGH", edge(*back, 2)))).alias("_e"))
        r = r.where(F.col("_e").isNotNull()).select("story_id", "type", "_e.source_event_id", "_e.target_event_id", "rationale",
                                                    "src_seq", "tgt_seq", "l_partkey", "_e.variant")
        o = self.orders
        v3 = (o.where((F.col("event_seq") == 1) & (F.col("o_orderpriority") == "5-LOW")
                      & (F.col("o_orderstatus") == "F"))
              .select("story_id", F.lit("causal").alias("type"), F.col("event_key").alias("source_event_id"),
                      F.col("event_key").alias("target_event_id"), F.lit("loop").alias("rationale"),
                      F.col("event_seq").alias("src_seq"), F.col("event_seq").alias("tgt_seq"),
                      F.lit(0).cast("long").alias("l_partkey"), F.lit(3).alias("variant")))
        r = seq_number(self.by_story(r.unionByName(v3)), ["story_id"], ["src_seq", "tgt_seq", "l_partkey", "variant"], "rel_seq")
        return r.select("story_id", "rel_seq", "type", "source_event_id", "target_event_id", "rationale")

    # F5
    @cached_property
    def event_rows(self) -> DataFrame:
        """Not persisted: who counts rows reads neither lines nor details."""
        o = self.order_keys.where(F.col("o_orderstatus") != "P").select(
            "story_id", "o_orderkey", F.col("event_seq").alias("o_seq"))
        o = seq_number(o, ["story_id"], ["o_seq"], "event_seq").drop("o_seq")
        return o.join(self.order_detail, F.col("o_orderkey") == F.col("_key"))

    @shared
    def event_keys(self) -> DataFrame:
        return self.by_story(self.event_rows)

    @cached_property
    def events(self) -> DataFrame:
        """Accepted events (not pending orders), renumbered densely, with full Event fields."""
        return self.event_keys.select("o_orderkey", "story_id", _event_key("o_orderkey").alias("event_id"), "event_seq",
                                      *self._event_fields())

    # F6
    @shared
    def sub_event_keys(self) -> DataFrame:
        o = self.order_keys.select("story_id", "o_orderkey", F.col("event_seq").alias("o_seq"))
        li = self.t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
                                       "l_linestatus", "l_returnflag")
        s = self.by_story(li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey"))
        # lines may agree in all four columns: without the last two their order, and with it their ids, would be that of arrival
        return seq_number(s, ["story_id"], ["o_seq", "l_linenumber", "l_partkey", "l_suppkey", F.desc("l_shipdate"),
                                            "l_quantity"], "sub_seq")

    @staticmethod
    def _natural_id() -> F.Column:
        return F.concat(F.lit("E"), (F.col("l_orderkey") % 7).cast("string"), F.lit("_S"),
                        F.col("l_linenumber").cast("string"))

    @staticmethod
    def _sub_event_fields() -> dict[str, F.Column]:
        ch = F.struct(_supplier(F.col("l_suppkey")).alias("name"), F.col("l_linestatus").alias("role"),
                      _state("l_returnflag").alias("state"))
        return {"parent_event_id": _event_key("l_orderkey"),
                "title": F.concat(F.lit("Line "), F.col("l_linenumber").cast("string"), F.lit(" of "),
                                  _event_key("l_orderkey")),
                "summary": F.concat(_supplier(F.col("l_suppkey")), F.lit(" ships part "), F.col("l_partkey").cast("string")),
                "characters": F.array(ch), "chapter_id": F.year("l_shipdate")}

    @cached_property
    def sub_events_raw(self) -> DataFrame:
        """Sub-events as the model returns them: ids collide across events; one character each."""
        x = {k: c.alias(k) for k, c in self._sub_event_fields().items()}
        return self.sub_event_keys.select(
            "story_id", x["parent_event_id"], "o_seq", self._natural_id().alias("sub_event_id"), x["title"], x["summary"],
            x["characters"], "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", x["chapter_id"], "sub_seq")

    @shared
    def sub_event_ids(self) -> DataFrame:
        """Sub-events after story-wide id resolution (P3), without their texts."""
        from longform.operators.planning import resolve_sub_event_ids
        return resolve_sub_event_ids(self.sub_event_keys.withColumn("sub_event_id", self._natural_id())).drop(
            "natural_sub_event_id")

    @cached_property
    def sub_events(self) -> DataFrame:
        x = {k: c.alias(k) for k, c in self._sub_event_fields().items()}
        return self.sub_event_ids.select(
            "story_id", x["parent_event_id"], "o_seq", self._natural_id().alias("natural_sub_event_id"), x["title"],
            x["summary"], x["characters"], "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
            x["chapter_id"], "sub_seq", "sub_event_id")

    # F7
    @cached_property
    def plan_members(self) -> DataFrame:
        """Chapter membership: every sub-event in its ship year except single-unit lines, full lines also in the
        next year's chapter, two-unit lines also under an id the plan does not know."""
        q, year, own = F.col("l_quantity"), F.col("chapter_id"), F.col("sub_event_id")

        def member(chapter: F.Column, name: F.Column, variant: int) -> F.Column:
            return F.struct(chapter.alias("chapter_id"), name.alias("sub_event_id"), F.lit(variant).alias("variant"))

        s = self.sub_events.select("story_id", "l_shipdate", "sub_seq", F.explode(F.array(
            F.when(q != 1, member(year, own, 0)), F.when(q == 50, member(year + 1, own, 1)),
            F.when(q == 2, member(year, F.concat(own, F.lit("_x")), 2)))).alias("_m"))
        return s.where(F.col("_m").isNotNull()).select("story_id", "_m.chapter_id", "_m.sub_event_id", "l_shipdate",
                                                       "sub_seq", "_m.variant")

    @shared
    def chapters(self) -> DataFrame:
        """Chapters in list order (``chapter_pos``); every fourth story lists its chapters newest first."""
        m = self.plan_members
        order = F.struct("l_shipdate", "sub_seq", "variant")
        c = m.groupBy("story_id", "chapter_id").agg(ordered_list(F.col("sub_event_id"), order).alias("sub_event_ids"))
        key = F.when(F.col("story_id") % 4 == 0, -F.col("chapter_id")).otherwise(F.col("chapter_id"))
        c = seq_number(c.withColumn("_k", key), ["story_id"], ["_k"], "chapter_pos").drop("_k")
        return c.select("story_id", "chapter_pos", F.col("chapter_id").cast("int").alias("chapter_id"),
                        F.concat(F.lit("Chapter "), F.col("chapter_id").cast("string")).alias("title"),
                        F.concat(F.lit("Lines shipped in "), F.col("chapter_id").cast("string")).alias("summary"),
                        "sub_event_ids")

    # F8
    @cached_property
    def passage_rows(self) -> DataFrame:
        """Not persisted: who counts rows reads no names of parts."""
        from longform.operators.writing import reading_order
        r = reading_order(self.chapters).select("story_id", "pos", "chapter_pos", "chapter_id", "sub_event_id")
        s = self.sub_event_ids.select("story_id", "sub_event_id", "sub_seq", "l_partkey", "l_suppkey")
        p = self.t("part").select("p_partkey", "p_name", "p_type")
        x = r.join(s, ["story_id", "sub_event_id"]).join(p, F.col("l_partkey") == F.col("p_partkey"))
        return x.drop("l_partkey", "p_partkey")

    @shared
    def passage_keys(self) -> DataFrame:
        return self.by_story(self.passage_rows)

    @cached_property
    def passages(self) -> DataFrame:
        """A written passage per reading slot of a known sub-event."""
        x = self.passage_keys.withColumn("name", _supplier(F.col("l_suppkey")))
        said = F.concat("p_name", F.lit(" met "), "name", F.lit(". "), "p_type", F.lit("."))
        other = (F.col("l_suppkey") + F.when(F.col("sub_seq") % 5 == 0, 1).otherwise(0)).cast("string")
        raw = F.concat(said, F.lit(" Supplier "), other, F.lit(" left. "), "p_name", F.lit(" met "), "name",
                       F.lit("."))
        issues = (F.when(F.col("sub_seq") % 4 == 0, F.array().cast("array<string>"))
                  .when(F.col("sub_seq") % 4 == 1, F.array(F.lit("repetition")))
                  .otherwise(F.array(F.lit("wrong name"), F.lit("repetition"))))
        return x.select(
            "story_id", "pos", "chapter_pos", "chapter_id", "sub_event_id", "sub_seq",
            F.concat(F.lit("Earlier, "), "p_name", F.lit(" was seen.")).alias("summary_text"),
            ((F.col("sub_seq") % 120).cast("double") / 100).alias("relevance_score"),
            raw.alias("raw_text"),
            F.concat(F.lit("tighten "), "p_type").alias("suggestions"),
            issues.alias("issues"),
            F.when(F.col("sub_seq") % 3 == 0, F.lit("")).otherwise(said).alias("revised_text"),
            ((F.col("sub_seq") * 37 % 110).cast("double") / 100).alias("confidence"))

    # F9
    @cached_property
    def responses(self) -> DataFrame:
        """Model responses in five shapes: clean, fenced, list with bad elements, cut off, with chatter."""
        e = self.t("events").select("event_id", "props")
        k = F.col("event_id") % 5
        text = (F.when(k == 0, F.col("props"))
                .when(k == 1, F.concat(F.lit("```json "), "props", F.lit(" ```")))
                .when(k == 2, F.concat(F.lit("["), "props", F.lit(',{"k":"x"},7]')))
                .when(k == 3, F.substring("props", 1, 4))
                .otherwise(F.concat(F.lit("Sure: "), "props")))
        return e.select(F.col("event_id").alias("request_id"), text.alias("response_text"))
