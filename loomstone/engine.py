"""One object over the store: add messages, flush, derive facts and themes, search, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.functions import providers
from loomstone.functions import text as X
from loomstone.operators import hierarchy, prediction, retrieval, segments, themes
from loomstone.operators import vector_graph as G
from loomstone.operators import vector_search as VS
from loomstone.runtime import Settings
from loomstone.shipping import ship
from loomstone.sources.delta_store import DeltaStore
from loomstone.sources.deltas import Deltas
from loomstone.sources.lexical_index import LexicalIndex
from loomstone.sources.store import KEYS, SCHEMAS, Repository, scratch, written
from loomstone.sources.theme_state import ThemeState


class MemoryEngine:
    """Everything lazy is a DataFrame; what changes the store runs at once. The store may be any repository.

    All state is under root: the store, messages that wait in buffers, the
    batches taken, what was consumed, the graph and the lexical indexes. A
    new engine on the same root goes on where the last one ended. One writer
    at a time.
    """

    def __init__(self, spark: SparkSession, root: str, embed: providers.Embedder = providers.hashed_trigrams, most: int = 25, least: int = 2, store: Repository | None = None):
        root = root.rstrip("/")
        ship(spark)
        self.spark, self.store, self.embed, self.most, self.least = spark, store or DeltaStore(spark, root), embed, most, least
        self._buffer = Deltas(spark, f"{root}/buffer", "key string, owner string, seq long, role string, content string, ts timestamp_ntz", "key", kinds=("row", "batch"))
        self._consumed = {kind: Deltas(spark, f"{root}/consumed/{kind}", "key string", "key") for kind in ("episodes", "semantic", "learned")}
        self._nodes = Deltas(spark, f"{root}/graph/nodes", "node_id long, level int, raw_id string, text string", "node_id")
        self._edges = Deltas(spark, f"{root}/graph/edges", "edge string, a string, b string, relation string", "edge")
        self._themes = ThemeState(spark, f"{root}/theme-state")
        self._index = {kind: LexicalIndex(spark, f"{root}/index/{kind}") for kind in ("episodes", "semantic")}

    @classmethod
    def configured(cls, spark: SparkSession, root: str, settings: Settings, **more) -> MemoryEngine:
        return cls(spark, root, most=settings.validate().buffer_most, least=settings.episode_least, **more)

    def __enter__(self) -> MemoryEngine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Ends the buffers: what is in them becomes episodes."""
        self.flush()

    def flush(self) -> None:
        """Episodes of what is left in all buffers; rests of fewer than `least` messages are lost."""
        held = self._buffer.read()
        if held.limit(1).take(1):
            self._take(segments.by_size(held.drop("key"), self.most, self.least))
            self._buffer.write(None, held)
            self._buffer.merge()

    def taken(self, batch: str) -> bool:
        """Whether a batch of messages was taken."""
        return bool(self._buffer.read("batch").filter(F.col("key") == batch).limit(1).take(1))

    def add_messages(self, messages: DataFrame, flush: bool = True, batch: str | None = None) -> None:
        """Episodes of messages (owner, seq, role, content, ts): buffers cut by size. Without flush the rests wait for the next messages.

        batch names these messages: a name that was taken before changes
        nothing. Episodes are stored by the hash of what they say, and buffers
        and the batch's name change together after them, so a call that dies
        and is repeated with its name gives what one call gives.
        """
        if batch is not None and self.taken(batch):
            return
        d = messages.select(F.col("owner").cast("string").alias("owner"), F.col("seq").cast("long").alias("seq"), "role", "content", F.col("ts").cast("timestamp_ntz").alias("ts"))
        root = scratch(self.spark, "buffers")
        d = written(d, f"{root}/new")
        held = self._buffer.read()
        if not flush:
            # Other owners' buffers stay as they are.
            held = held.join(d.select("owner").distinct(), "owner", "left_semi")
        held = written(held, f"{root}/held")
        every = held.drop("key").unionByName(d)
        marks = {} if batch is None else {"batch": self.spark.createDataFrame([(batch,)], "key string")}
        if flush:
            self._take(segments.by_size(every, self.most, self.least))
        else:
            rest = segments.left_over(every, self.most)
            self._take(segments.by_size(every, self.most).join(rest.select("owner", "seq"), ["owner", "seq"], "left_anti"))
            marks["row"] = rest.withColumn("key", F.concat_ws("\0", "owner", "seq"))
        self._buffer.write(marks, held)
        self._buffer.merge()

    def sink(self, stream: DataFrame, name: str):
        """A writer of a stream of messages: each of its batches is taken once, however often it is tried. The caller sets checkpoint and trigger and starts it."""
        return stream.writeStream.foreachBatch(lambda d, i: self.add_messages(d, flush=False, batch=f"{name}:{i}"))

    def _take(self, cut: DataFrame) -> None:
        e = segments.fallback_episodes(cut, ["owner", "episode"])
        raw = cut.groupBy("owner", "episode").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("m"))
        key = F.sha2(F.concat_ws("\0", F.col("owner").cast("string"), F.col("ts").cast("string"), "content"), 256)
        rows = e.join(raw, ["owner", "episode"]).withColumns(
            {
                "user_id": F.col("owner").cast("string"),
                "episode_id": key,
                "original_messages": F.transform("m", lambda m: F.struct(F.concat_ws(":", F.col("owner").cast("string"), m["seq"].cast("string")).alias("message_id"), m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("map<string,string>").alias("metadata"))),
                "message_count": F.col("message_count").cast("int"),
                "boundary_reason": F.lit("size"),
                "created_at": F.col("ts").cast("string"),
                "timestamp": F.col("ts").cast("string"),
                "metadata": F.lit(None).cast("map<string,string>"),
                "tags": F.array().cast("array<string>"),
            }
        )
        self.store.add_absent("episodes", rows.select(*self._columns("episodes")))
        self.refresh_index("episodes")

    def _columns(self, kind: str) -> list[str]:
        return self.spark.createDataFrame([], SCHEMAS[kind]).columns

    def derive_facts(self, extract: providers.FactExtractor | None = None, dedup_above: float = 1.0) -> None:
        """Sentences of the messages of all episodes as facts, user by user in one plan; those whose text a user's fact has are left out.

        extract may give other statements (user_id, episode_id, pos,
        statement), episode_id being a message's. Below 1, facts whose cosine
        with an earlier one of their user is above dedup_above are left out too.
        """
        e = self.store.read("episodes")
        m = e.select("user_id", "created_at", F.col("episode_id").alias("of"), F.explode("original_messages").alias("m")).select("user_id", "created_at", "of", F.col("m.message_id").alias("episode_id"), F.col("m.content").alias("content"))
        said = providers.statements(m).select("episode_id", "content") if extract is None else extract(m).select("episode_id", F.trim("statement").alias("content")).filter("content <> ''")
        s = said.join(m.drop("content"), "episode_id")
        first = s.groupBy("user_id", X.statement_key(F.col("content")).alias("k")).agg(F.min(F.struct("created_at", "content")).alias("f"), F.collect_set("of").alias("source_episodes"))
        null = lambda t: F.lit(None).cast(t)
        rows = first.select(F.sha2(F.concat_ws("\0", "user_id", "k"), 256).alias("memory_id"), "user_id", "f.content", F.lit("knowledge").alias("knowledge_type"), "f.created_at", null("string").alias("updated_at"), F.array_sort("source_episodes").alias("source_episodes"), F.lit(0.8).alias("confidence"), null("map<string,string>").alias("metadata"), F.array().cast("array<string>").alias("tags"), F.lit(1).alias("revision_count"))
        self.store.add_absent("semantic", self._without_near(rows.select(*self._columns("semantic")), dedup_above))
        self.refresh_index("semantic")

    def learn(self, model: prediction.Model | None = None, most: int = 10, least: float = 0.7) -> DataFrame:
        """Facts by prediction and correction of the episodes that were not learned from yet; the statements, as prediction.learned tells them.

        What is known of a user is found by the kept index, among the user's
        facts alone. Episodes count as learned from once their facts are
        stored; facts are stored by what they say, so a call that dies and is
        repeated stores none twice.
        """
        root = scratch(self.spark, "learned")
        seen = self._consumed["learned"].read().withColumnRenamed("key", "episode_id")
        e = written(self.store.read("episodes").join(seen, "episode_id", "left_anti"), f"{root}/episodes")
        episodes = e.select("user_id", "episode_id", "title", F.array_join(F.transform("original_messages", lambda m: F.coalesce(m["content"], F.lit(""))), "\n").alias("said"), F.col("timestamp").alias("ts"))
        facts = self.store.read("semantic").select("user_id", F.col("memory_id").alias("fact"), "content", "created_at")
        if not self._index["semantic"].deltas.folders():
            self.refresh_index("semantic")
        asked = episodes.select("user_id", F.col("episode_id").alias("query_id"), X.index_tokens(F.col("said")).alias("tokens"))
        near = self._index["semantic"].search(asked, 2 * most, ["user_id"])
        named = facts.select("user_id", "fact", F.xxhash64("fact").alias("doc"))
        near = written(near.join(named, "doc").select("query_id", "user_id", "fact", "rank", "score"), f"{root}/near")
        found = written(prediction.learned(episodes, facts, near, model, most, least), f"{root}/found")
        null = lambda t: F.lit(None).cast(t)
        rows = found.select(F.sha2(F.concat_ws("\0", "user_id", X.statement_key(F.col("statement"))), 256).alias("memory_id"), "user_id", F.col("statement").alias("content"), F.lit("knowledge").alias("knowledge_type"), "created_at", null("string").alias("updated_at"), F.array("episode_id").alias("source_episodes"), "confidence", null("map<string,string>").alias("metadata"), F.array().cast("array<string>").alias("tags"), F.lit(1).alias("revision_count"))
        self.store.add_absent("semantic", rows.select(*self._columns("semantic")))
        self.refresh_index("semantic")
        self._consumed["learned"].write(e.select(F.col("episode_id").alias("key")))
        self._consumed["learned"].merge()
        return found

    def _without_near(self, rows: DataFrame, above: float) -> DataFrame:
        """New facts without those that are near an earlier one of their user and type, stored or new; the oldest come first."""
        if above >= 1:
            return rows
        old = self.store.read("semantic")
        new = written(rows.join(old.select("memory_id"), "memory_id", "left_anti").select(*rows.columns), scratch(self.spark, "facts"))
        columns = ["memory_id", "user_id", "knowledge_type", "content", "created_at"]
        every = old.select(*columns, F.lit(0).alias("late")).unionByName(new.select(*columns, F.lit(1).alias("late")))
        order = Window.partitionBy("user_id").orderBy("late", "created_at", "memory_id")
        every = written(every.withColumn("fact", F.row_number().over(order).cast("long")), scratch(self.spark, "ordered"))
        v = providers.embedded(every.select("user_id", F.col("knowledge_type").alias("kind"), "fact", "content"), "content", "v", self.embed)
        near = themes.greedy_dedup(v.select("user_id", "kind", "fact", "v"), above).filter("duplicate_of is not null").select("user_id", "fact")
        return new.join(every.join(near, ["user_id", "fact"]).select("memory_id"), "memory_id", "left_anti").select(*rows.columns)

    def _entities(self, kind: str) -> DataFrame:
        """user_id, doc (hash of the key), text of a kind."""
        key, text = ("memory_id", F.col("content")) if kind == "semantic" else ("episode_id", F.concat_ws(" ", "title", "content"))
        return self.store.read(kind).select("user_id", F.xxhash64(key).alias("doc"), text.alias("text"))

    def refresh_index(self, kind: str) -> None:
        """Brings the kept index of a kind in line with the store: only what is new is tokenised, what is gone there goes here."""
        index, here = self._index[kind], self._entities(kind)
        lost = index.documents().join(here.select("doc"), "doc", "left_anti")
        if lost.limit(1).take(1):
            index.delete(lost)
        index.add(here)
        index.merge()

    def increment(self, kind: str) -> DataFrame:
        """The rows of a kind that were not consumed yet."""
        return hierarchy.unconsumed(self.store.read(kind), self._consumed[kind].read().withColumnRenamed("key", KEYS[kind]), KEYS[kind])

    def consume(self, kind: str, rows: DataFrame | None = None) -> None:
        """From now on increment() gives later rows only: those besides rows, by default besides all that it gives now."""
        rows = self.increment(kind) if rows is None else rows
        self._consumed[kind].write(rows.select(F.col(KEYS[kind]).alias("key")))
        self._consumed[kind].merge()

    def update_graph(self) -> tuple[int, int]:
        """Takes what was not consumed into the graph of messages, episodes, facts and themes; the numbers of all nodes and edges."""
        root = scratch(self.spark, "graph")
        # What is consumed at the end is what was seen here, though others may add meanwhile.
        e, f = (written(self.increment(kind), f"{root}/{kind}") for kind in ("episodes", "semantic"))
        messages = F.transform("original_messages", lambda m: m["message_id"])
        t = self.themes().select(F.concat_ws(":", "user_id", F.col("theme").cast("string")).alias("theme_id"), "fact")
        t = t.join(self.store.read("semantic").select(F.xxhash64("memory_id").alias("fact"), "memory_id"), "fact").groupBy("theme_id").agg(F.collect_list("memory_id").alias("semantic_ids"))
        node = lambda d, level, key, text: d.select(F.lit(level).alias("level"), key.alias("raw_id"), text.alias("text"))
        m = e.select(F.explode("original_messages").alias("m"))
        new = node(m, 0, F.col("m.message_id"), F.col("m.content")).unionByName(node(e, 1, F.col("episode_id"), F.col("title"))).unionByName(node(f, 2, F.col("memory_id"), F.col("content"))).unionByName(node(t, 3, F.col("theme_id"), F.lit("")))
        edges = hierarchy.increment_edges(e.select("episode_id", messages.alias("message_ids")), f.select("memory_id", "source_episodes"), t)
        old_nodes, old_edges = self._nodes.read(), self._edges.read()
        nodes = written(hierarchy.upsert_nodes(old_nodes, new), f"{root}/nodes")
        both = old_edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("relation").alias("kind"), F.lit(-1).alias("seq")).unionByName(edges)
        simple = written(hierarchy.simple_edges(both).select(F.concat_ws("\0", "a", "b").alias("edge"), "a", "b", F.col("kind").alias("relation")), f"{root}/edges")
        # Only what is new or changed is written; a repeated call finds nothing, as ids stay with their raw ids.
        for deltas, rows, old in ((self._nodes, nodes, old_nodes), (self._edges, simple, old_edges)):
            same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in deltas.columns]
            changed = rows.alias("n").join(old.alias("o"), same, "left_anti")
            deltas.write(changed, changed)
            deltas.merge()
        for kind, seen in (("episodes", e), ("semantic", f)):
            self.consume(kind, seen)
        return nodes.count(), simple.count()

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """nodes (node_id, level, raw_id, text) and edges (a, b, kind) as the last update left them."""
        return self._nodes.read(), self._edges.read().select("a", "b", F.col("relation").alias("kind"))

    def neighbours(self, k: int = 10) -> DataFrame:
        """src, dst, rank, sim: the nearest facts of each fact that was not consumed, among all."""
        vectors = lambda d: providers.embedded(d.select(F.xxhash64("memory_id").alias("id"), "content"), "content", "v", self.embed).select("id", "v")
        return G.knn(vectors(self.increment("semantic")), vectors(self.store.read("semantic")), k)

    def search_all(self, queries: DataFrame, k_episodes: int = 10, k_facts: int = 10, method: str = "hybrid", combined: int | None = None) -> DataFrame:
        """category, query_id, kind, item, rank, score of both kinds of memory; k = 0 gives none of a kind."""
        lists = {"episodic": (self.search(queries, "episodes", method, max(1, k_episodes)), k_episodes), "semantic": (self.search(queries, "semantic", method, max(1, k_facts)), k_facts)}
        return retrieval.categorised(lists, combined)

    def themes(self) -> DataFrame:
        """user_id, fact, theme of all facts: the kept themes, extended by the facts that are new."""
        f = self.store.read("semantic").select("user_id", F.xxhash64("memory_id").alias("fact"), "content")
        self._themes.update(f, lambda d: providers.embedded(d, "content", "v", self.embed))
        return self._themes.read()

    def search(self, queries: DataFrame, kind: str = "semantic", method: str = "hybrid", k: int = 10, strict: bool = True) -> DataFrame:
        """query_id, item (hash of the row's key), rank, score for queries (query_id, text) by a method of retrieval.METHODS; another one is an error, or hybrid if not strict."""
        d = self._entities(kind)
        if not self._index[kind].deltas.folders():
            self.refresh_index(kind)

        def words(most: int) -> DataFrame:
            asked = queries.select("query_id", X.index_tokens(F.col("text")).alias("tokens"))
            return self._index[kind].search(asked, most).select("query_id", F.col("doc").alias("item"), "rank", "score")

        def vectors() -> tuple[DataFrame, DataFrame]:
            q = providers.embedded(queries, "text", "q", self.embed).select("query_id", "q")
            return q, providers.embedded(d, "text", "v", self.embed).select(F.col("doc").alias("vec_id"), "v")

        def near(most: int) -> DataFrame:
            return VS.topk(*vectors(), most, min_score=0.1).select("query_id", F.col("vec_id").alias("item"), "rank", "score")

        def lift(most: int) -> DataFrame:
            return retrieval.noisy_lift(*vectors(), most)

        return retrieval.dispatched(method, words, near, k, lift, strict)

    def stats(self) -> DataFrame:
        """kind, user_id, items, chars, first, last."""
        a, b = (self.store.stats(k).select(F.lit(k).alias("kind"), "*") for k in ("episodes", "semantic"))
        return a.unionByName(b)

    def clean(self) -> int:
        """Deletes folders of all kept state that no new plan reads; how many. DataFrames that were made before fail afterwards."""
        deltas = [self._buffer, self._nodes, self._edges, *self._consumed.values(), *(i.deltas for i in self._index.values())]
        return sum(d.clean() for d in deltas) + self._themes.clean() + (self.store.clean() if isinstance(self.store, DeltaStore) else 0)

    def delete_user(self, user_id: str) -> None:
        self.store.delete_user(user_id)
        for kind in self._index:
            self.refresh_index(kind)
