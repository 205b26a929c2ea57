"""The engine: build and update an index over trees of files, search it, explain, list."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborseek.chunking import chunk_documents
from arborseek.config import Config, effective_trees, match_rules, merge_matched
from arborseek.functions.terms import STOP
from arborseek.functions.text import breadcrumb, title
from arborseek.operators import changes, context, highlight, keywords, ranking, scoring, similar
from arborseek.operators.index import BOOSTS, COLUMNS, EXPANDED, FIELDS, Index, among
from arborseek.query.ast import Expr, leaf_terms, to_query, tree_lines
from arborseek.query.compiler import Compiler, analyze, expand
from arborseek.query.parser import join_queries, parse
from arborseek.session import written
from arborseek.sources.files import discover, plain_path, read_spans

MANIFEST = "run_id long, abs_path string, tree string, path string, mtime timestamp, op string"
COMPACT = 8  # updates after which the index is written anew


class Engine:
    """An index in a folder that all executors share.

    The folder holds generations ``g-…`` and small files ``state-<n>.json``, of which the one with the greatest number
    is in force: it names the generations that make up the index, and the parts of the manifest. An update writes a
    generation of what changed, and then the next of these files; nothing in force is ever deleted or replaced, so a
    reader never sees half of an index and a failed update leaves none behind. After ``COMPACT`` updates, or once they
    hold as much as half of the first generation, an update writes the whole index anew. :meth:`vacuum` deletes
    what is no longer in force.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Config):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._index: tuple[list[str], Index] | None = None

    # --- index

    def _states(self) -> list[str]:
        at = self._path(self.folder)
        if not self._fs.exists(at):
            return []
        return sorted(n for x in self._fs.listStatus(at) if (n := x.getPath().getName()).startswith("state-") and n.endswith(".json"))

    def _current(self) -> dict | None:
        names = self._states()
        if not names:
            return None
        stream = self._fs.open(self._path(f"{self.folder}/{names[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put_current(self, state: dict) -> None:
        names = self._states()
        number = int(names[-1][6:-5]) + 1 if names else 0
        draft, final = self._path(f"{self.folder}/draft-{uuid.uuid4().hex}"), self._path(f"{self.folder}/state-{number:012d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise OSError("the new generation could not be put in force")

    def vacuum(self) -> None:
        """Delete all states but the last and the generations that it doesn't name. No reader may still use them."""
        now = self._current()
        if now is None:
            return
        kept = {*now["index"], *now["manifest"], self._states()[-1]}
        for x in self._fs.listStatus(self._path(self.folder)):
            name = x.getPath().getName()
            if name not in kept and name.startswith(("g-", "state-", "draft-")):
                self._fs.delete(x.getPath(), True)

    def status(self) -> str:
        """``missing``, ``config_changed``, ``stale`` (files differ from the manifest) or ``current``."""
        now = self._current()
        if now is None:
            return "missing"
        if now["config"] != self.config.hash():
            return "config_changed"
        return "stale" if self._diff(self._listing(), now).limit(1).count() else "current"

    def _listing(self) -> DataFrame:
        """``(key, abs_path, tree, path, mtime)`` of the files there are; contents aren't read."""
        return discover(self.spark, self.config.trees).select(F.concat_ws(":", "tree", "path").alias("key"), "abs_path", "tree", "path", "mtime")

    def _manifest(self, now: dict | None) -> DataFrame:
        """``(key, version)`` of the recorded files: the last entry of each, unless it took the file out."""
        if now is None:
            return self.spark.createDataFrame([], "key string, version timestamp")
        log = self.spark.read.schema(MANIFEST).parquet(*[f"{self.folder}/{g}/manifest" for g in now["manifest"]])
        entry = F.max(F.struct("run_id", "op", F.date_trunc("second", "mtime").alias("version"))).alias("entry")
        last = log.groupBy(F.concat_ws(":", "tree", "path").alias("key")).agg(entry)
        return last.where("entry.op = 'put'").select("key", "entry.version")

    def _diff(self, listing: DataFrame, now: dict | None) -> DataFrame:
        return changes.changes(listing.select("key", F.date_trunc("second", "mtime").alias("version")), self._manifest(now))

    def _contents(self, fresh: DataFrame) -> DataFrame:
        """``(tree, path, content)`` of files: read by name, unless they are more than EXPANDED; then all are read and joined."""
        few = fresh.select("abs_path", "tree", "path").limit(EXPANDED + 1).collect()
        if len(few) > EXPANDED:
            return discover(self.spark, self.config.trees).select("tree", "path", "content").join(fresh.select("tree", "path"), ["tree", "path"], "left_semi")
        here = [r for r in few if self._fs.exists(self._path(r["abs_path"]))]
        if not here:
            return self.spark.createDataFrame([], "tree string, path string, content binary")
        files = self.spark.read.format("binaryFile").load([re.sub(r"([\\*?\[\]{}])", r"\\\1", r["abs_path"]) for r in here])
        names = F.broadcast(self.spark.createDataFrame(here, "abs_path string, tree string, path string"))
        return files.select(plain_path("path").alias("abs_path"), "content").join(names, "abs_path").select("tree", "path", "content")

    def index(self, full: bool = False) -> dict:
        """Build the index, or bring it up to date; counts of what was done.

        The files are listed once, and that listing is what is compared, read and recorded: a file that changes
        meanwhile has another time at the next run and is taken again. Chunks of changed and removed documents go by
        document, so none stays behind. Files that can't be read are counted and left out of the manifest, to be tried
        again.
        """
        now = None if full else self._current()
        if now is not None and now["config"] != self.config.hash():
            now = None
        listing = written(self._listing(), "listing")
        diff = written(self._diff(listing, now), "file-changes")
        counts = {r["change_kind"]: r["count"] for r in diff.groupBy("change_kind").count().collect()}
        done = {k: counts.get(k, 0) for k in ("added", "modified", "removed")}
        done["processed"] = done["added"] + done["modified"]
        done["skipped"] = listing.count() - done["processed"]
        if now and not counts:
            return done | {"errors": 0, "oversized": 0, "chunks": self._load().count}
        fresh = listing.join(diff.where("change_kind <> 'removed'"), "key", "left_semi")
        generation = f"g-{uuid.uuid4().hex}"
        base = f"{self.folder}/{generation}"
        made = chunk_documents(self._contents(fresh)).join(fresh.select(F.col("key").alias("doc_id"), "mtime"), "doc_id")
        made = written(made, "fresh-chunks")
        errors = made.where("error is not null").select("doc_id").distinct()
        good = made.where("error is null").select(F.col("doc_id").alias("key")).distinct()
        rows = made.where("error is null").drop("error").select("id", *COLUMNS)
        gone = diff.where("change_kind <> 'added'").select(F.col("key").alias("doc_id"))
        index = self._load() if now else None
        grown = index is not None and (len(now["index"]) > COMPACT or now["added_chunks"] + rows.count() > now["base_chunks"] / 2)
        if index is None or grown:
            if index is not None:
                rows = rows.unionByName(index.chunks.select("id", *COLUMNS).join(gone, "doc_id", "left_anti"))
            parts = [generation]
            base_chunks, added = Index.build(rows, f"{base}/index", self.config.settings["stemmer"]).count, 0
        else:
            index.extend(rows, gone, f"{base}/index")
            parts = [*now["index"], generation]
            base_chunks, added = now["base_chunks"], now["added_chunks"] + rows.count()
        place = now["run"] + 1 if now else 0
        puts = fresh.join(good, "key", "left_semi").select("key", "abs_path", "tree", "path", "mtime", F.lit("put").alias("op"))
        drops = diff.where("change_kind <> 'added'").join(good, "key", "left_anti").select("key", F.lit(None).cast("string").alias("abs_path"), F.split("key", ":", 2)[0].alias("tree"), F.split("key", ":", 2)[1].alias("path"), F.lit(None).cast("timestamp").alias("mtime"), F.lit("drop").alias("op"))
        puts.unionByName(drops).withColumn("run_id", F.lit(place).cast("long")).select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.parquet(f"{base}/manifest")
        manifest = [*now["manifest"], generation] if now else [generation]
        self._put_current({"index": parts, "manifest": manifest, "run": place, "base_chunks": base_chunks, "added_chunks": added, "config": self.config.hash()})
        self._index = None
        # chunks above the limit are kept whole and told
        oversized = made.where(F.char_length("body") > self.config.settings["max_chunk_size"]).count()
        return done | {"errors": errors.count(), "oversized": oversized, "chunks": self._load().count}

    def _load(self) -> Index:
        now = self._current()
        if now is None:
            raise RuntimeError("there is no index; call index() first")
        if self._index is None or self._index[0] != now["index"]:
            self._index = now["index"], Index.read(self.spark, *[f"{self.folder}/{g}/index" for g in now["index"]])
        return self._index[1]

    def _trees(self) -> DataFrame:
        return self.spark.createDataFrame([(t.name, t.is_global) for t in self.config.trees], "name string, is_global boolean")

    def params(self, **given) -> ranking.SearchParams:
        """Parameters: those given, else those of the configuration."""
        s = self.config.settings
        base = ranking.SearchParams(limit=s["limit"], pool=s["aggregation_pool_size"], cutoff_ratio=s["cutoff_ratio"], threshold=s["aggregation_threshold"], local_boost=s["local_boost"], fuzzy=s["fuzzy_distance"])
        return replace(base, **{k: tuple(v) if k == "trees" and v is not None else v for k, v in given.items() if v is not None})

    # --- search

    def search(self, *queries: str, details: bool = True, **given) -> DataFrame:
        """Results of one query or several, in order of ``rank``."""
        text = join_queries(list(queries)) if queries else ""
        return self.search_expr(parse(text), details, **given)

    def search_expr(self, e: Expr | None, details: bool = True, **given) -> DataFrame:
        params, index = self.params(**given), self._load()
        compiler = Compiler(index, fuzzy=params.fuzzy)
        results = ranking.pipeline(compiler.run(e), index.chunks, self._trees(), params).withColumnRenamed("rank_in", "rank")
        shown = self._hydrate(results, index, params.limit)
        if not details or e is None:
            return shown.orderBy("rank")
        return self._marked(shown, index, e, params.fuzzy).orderBy("rank")

    def _hydrate(self, results: DataFrame, index: Index, limit: int) -> DataFrame:
        """Results with their texts. Those within EXPANDED, as a limit of results is, are looked up by their ids."""
        texts = index.chunks.select("id", "parent_id", "path", "body", "depth", "byte_start", "byte_end", title("hierarchy").alias("title"), breadcrumb("hierarchy").alias("breadcrumb"))
        if limit > EXPANDED:
            return results.join(texts, "id")
        found = results.collect()
        few = F.broadcast(self.spark.createDataFrame(found, results.schema))
        shown = texts.where(among("id", [r["id"] for r in found])).join(few, "id").select(*results.columns, *[c for c in texts.columns if c != "id"])
        return self._with_spans(shown, {r["doc_id"] for r in found if r["is_aggregated"]}) if "is_aggregated" in results.columns else shown

    def _with_spans(self, shown: DataFrame, rolled_up: set[str]) -> DataFrame:
        """Rolled-up results with the text of their whole section, read from its file; where that is gone their own text stays."""
        roots = {t.name: t.path.rstrip("/") for t in self.config.trees}
        names = [(f"{roots[tree]}/{path}", tree, path) for tree, _, path in (d.partition(":") for d in sorted(rolled_up)) if tree in roots]
        if not names:
            return shown
        whole = self._contents(self.spark.createDataFrame(names, "abs_path string, tree string, path string"))
        return read_spans(shown, whole).withColumn("body", F.when(F.col("is_aggregated"), F.coalesce("span", "body")).otherwise(F.col("body"))).drop("span")

    def _marked(self, shown: DataFrame, index: Index, e: Expr, fuzzy: int) -> DataFrame:
        """Results with ranges of the words near those of the query, snippets, and ranges of what they were rolled up from.

        Which words are near is found in the results' own texts, not in the vocabulary. A rolled-up result has the
        ranges of the chunks it was made of, moved to where they stand in its text, those beyond its end dropped, and merged.
        """
        near = highlight.NearWords([w for t in leaf_terms(e) for w in analyze(t, index.language)], fuzzy)
        marked = highlight.with_ranges(shown, "body", near, index.language)
        marked = highlight.with_ranges(marked, "title", near, index.language, "title_ranges")
        marked = highlight.with_ranges(marked, "path", near, index.language, "path_ranges")
        marked = highlight.with_matches(marked, ["body", "title", "path"], near, index.language)
        if "constituents" in marked.columns:
            inner = marked.where(F.size("constituents") > 0).select("rank", F.col("byte_start").alias("start"), F.octet_length("body").alias("size"), F.explode("constituents.id").alias("id"))
            parts = inner.join(index.chunks.select("id", "body", "byte_start"), "id")
            moved = highlight.with_ranges(parts, "body", near, index.language).withColumn("ranges", highlight.shift_ranges(F.col("ranges"), F.col("byte_start") - F.col("start"), F.col("size")))
            moved = highlight.with_matches(moved, ["body"], near, index.language)
            sums = moved.groupBy("rank").agg(F.flatten(F.collect_list("ranges")).alias("__inner"), F.sum("matches").alias("__matches"))
            marked = marked.join(sums, "rank", "left").withColumn("ranges", F.coalesce(highlight.merged(F.col("__inner")), "ranges")).withColumn("matches", F.coalesce("__matches", "matches")).drop("__inner", "__matches")
        return highlight.with_snippet(marked, "body", near, index.language)

    def like_this(self, id: str | None = None, fields: dict[str, str] | None = None, similar_params: similar.SimilarParams | None = None, exclude: tuple[str, ...] = (), **given) -> DataFrame:
        """Results like a chunk of the index, or like given texts by field; the chunk itself is no result."""
        index, params = self._load(), self.params(**given)
        source = similar.source_of_chunk(index, id) if id is not None else similar.source_of_fields(index, fields or {})
        out = tuple(exclude) + ((id,) if id is not None else ())
        found = similar.more_like(source, index, similar_params or similar.SimilarParams(), out)
        results = ranking.pipeline(found, index.chunks, self._trees(), params).withColumnRenamed("rank_in", "rank")
        return self._hydrate(results, index, params.limit).orderBy("rank")

    def explain_like_this(self, id: str) -> DataFrame:
        """``(field, term, df, weight, score)``: the terms a search like the chunk asks for, and what each adds to a boosted score."""
        index = self._load()
        picked = similar.select_terms(similar.source_of_chunk(index, id), index)
        return picked.withColumn("score", F.col("weight") * scoring.bm25_idf("df", index.count)).orderBy(F.desc("weight"))

    def _stopwords(self) -> list[str]:
        """The library's stopwords and those of the configuration's list."""
        more = self.config.settings["stopwords_file"]
        return sorted({*STOP, *(Path(more).expanduser().read_text(encoding="utf-8").lower().split() if more else ())})

    def context_query(self, files: list[tuple[str, str]], algorithm: str = "textrank", trees: list[str] | None = None) -> tuple[Expr | None, object]:
        """The query that files ``(path, content)`` make, and what the rules say about them. The files are few: a user's."""
        index, n = self._load(), self.config.settings["context_terms"]
        shortest = self.config.settings["min_word_length"]
        matched = merge_matched([match_rules(self.config.rules, p) for p, _ in files])
        name = keywords.algorithm(algorithm)
        queries: list[Expr | None] = []
        if name == "tfidf":
            rows = self.spark.createDataFrame([(p, p, c) for p, c in files], "id string, path string, content string")
            md = F.lower("path").rlike(r"\.(md|markdown)$")
            stop = self._stopwords()
            own = context.markdown_terms(rows.where(md), shortest=shortest, stop=stop).unionByName(context.body_terms(rows.where(~md), column="content", shortest=shortest, stop=stop))
            merged = context.merge_terms(context.path_terms(rows, shortest=shortest, stop=stop).unionByName(own))
            kept = effective_trees(trees, matched.trees)
            stats, count = index.terms.where("field = 'body'"), index.count
            if kept is not None:
                part = ranking.in_trees(index.postings, kept).where("field = 'body'")
                stats, count = part.groupBy("term").agg(F.count("*").alias("df")), ranking.in_trees(index.chunks, kept).count()
            ranked = context.rank_terms(merged, stats, count, language=index.language).select("id", "term", "score").collect()
            for p, _ in files:
                queries.append(context.build_query([(r["term"], r["score"]) for r in ranked if r["id"] == p], n))
        else:
            queries = [context.build_query(keywords.EXTRACTORS[name](c), n) for _, c in files]
        return context.combine(queries, matched.terms), matched

    def context(self, files: list[tuple[str, str]], algorithm: str = "textrank", **given) -> DataFrame:
        """Chunks that bear on the files: without their own documents, with those that rules include first."""
        trees = given.pop("trees", None)
        e, matched = self.context_query(files, algorithm, trees)
        chosen = {k: matched.overrides.get(k) for k in ("limit", "cutoff_ratio") if k in matched.overrides} | given
        params = replace(self.params(**chosen), trees=effective_trees(trees, matched.trees))
        index = self._load()
        found = ranking.pipeline(Compiler(index, fuzzy=params.fuzzy).run(e), index.chunks, self._trees(), params)
        own = self.doc_ids_for([p for p, _ in files])
        if own:
            found = found.where(~F.col("doc_id").isin(*own))
        return context.inject(found, matched.include, index.chunks, params.limit).withColumnRenamed("rank_in", "rank").orderBy("rank")

    def doc_ids_for(self, paths: list[str]) -> list[str]:
        """Document ids of files that lie below a tree's path."""
        return [f"{t.name}:{p[len(t.path.rstrip('/')) + 1 :]}" for p in paths for t in self.config.trees if p.startswith(t.path.rstrip("/") + "/")]

    def explain(self, *queries: str, **given) -> dict:
        """The expression as a tree and as a query, and how many rows each phase left."""
        e, params, index = parse(join_queries(list(queries))), self.params(**given), self._load()
        stats = ranking.pipeline_stats(Compiler(index, fuzzy=params.fuzzy).run(e), index.chunks, self._trees(), params).first().asDict()
        return {"tree": "\n".join(tree_lines(e)) if e else "", "query": to_query(e) if e else "", **stats}

    def details(self, query: str, **given) -> DataFrame:
        """``(id, word, term, field, tf, field_score, base_score)``: where terms near the query's words stand in its results.

        ``word`` is the query's word as the analyzer of the index gives it and ``term`` what it met; ``field_score`` adds
        up tf times the field's boost, ``base_score`` is the score before boosts and normalisation.
        """
        params, index, e = self.params(**given), self._load(), parse(query)
        words = [w for t in leaf_terms(e) for w in analyze(t, index.language)]
        hits = self.search(query, details=False, **given).select("id")
        base = Compiler(index, fuzzy=params.fuzzy).run(e).select("id", F.col("score").alias("base_score"))
        near = expand(index, words, FIELDS, params.fuzzy)
        few = near.limit(EXPANDED + 1).collect()
        found = index.postings
        if len(few) <= EXPANDED:
            near, found = F.broadcast(self.spark.createDataFrame(few, near.schema)), found.where(among("term", [r["term"] for r in few]))
        boost = F.create_map(*[x for f, b in BOOSTS.items() for x in (F.lit(f), F.lit(b))])
        rows = found.join(F.broadcast(hits), "id", "left_semi").join(near, ["field", "term"]).select("id", "word", "term", "field", "tf")
        scored = rows.withColumn("field_score", F.sum(F.col("tf") * boost[F.col("field")]).over(Window.partitionBy("id", "field")))
        return scored.join(base, "id", "left")

    # --- lists

    def get(self, id: str, full_document: bool = False) -> DataFrame:
        chunks = self._load().chunks
        found = chunks.where(F.col("doc_id") == id.partition("#")[0]) if full_document or "#" not in id else chunks.where(F.col("id") == id)
        if found.limit(1).count() == 0:
            raise KeyError(f"not found: {id}")
        return found.orderBy("id")

    def list_chunks(self, tree: str | None = None) -> DataFrame:
        chunks = self._load().chunks
        return (chunks if tree is None else chunks.where(F.col("tree") == tree)).select("id", "depth", breadcrumb("hierarchy").alias("breadcrumb")).orderBy("id")

    def list_docs(self, tree: str | None = None) -> DataFrame:
        chunks = self._load().chunks
        rows = chunks if tree is None else chunks.where(F.col("tree") == tree)
        return rows.groupBy("doc_id", "tree", "path").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("body")).alias("bytes"), F.min_by(title("hierarchy"), "id").alias("title")).orderBy("doc_id")

    def count(self) -> int:
        return self._load().count

    def to_json(self, query: str, results: DataFrame) -> str:
        """``{"queries": [{"query", "results", "total_matches"}]}`` of a limited result."""
        rows = [json.loads(r) for r in results.toJSON().collect()]
        return json.dumps({"queries": [{"query": query, "results": rows, "total_matches": sum(r.get("matches", 0) for r in rows)}]}, ensure_ascii=False)
