"""The query surface: tasks, anchors, handles, lists and projections over one generation of a graph."""

from __future__ import annotations

import json
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.functions import symbols as S
from lodestrand.functions import text as T
from lodestrand.functions.hashing import unsigned
from lodestrand.operators import expand, index, listing, project, retrieve, store
from lodestrand.operators.resolve import resolved_edges
from lodestrand.plans import render
from lodestrand.plans.virtual import Graph
from lodestrand.sources.extract import extract_files
from lodestrand.sources.scan import read_source, scan_tree

RELATIONS = {"callers": ("CALLERS", K.CALLS, -1), "callees": ("CALLEES", K.CALLS, 1), "refs": ("REFERENCES", K.REFERENCES, 0)}


def parse_id(text: str) -> int | None:
    """An unsigned decimal number of at most 64 bits, as the signed long that has its bits."""
    if not re.fullmatch(r"[0-9]+", text, re.ASCII) or int(text) >= 2**64:
        return None
    value = int(text)
    return value - 2**64 if value >= 2**63 else value


def parse_lines(text: str) -> tuple[int, int, int] | None:
    m = re.fullmatch(r"([0-9]+):([0-9]+)-([0-9]+)", text, re.ASCII)
    id = parse_id(m[1]) if m else None
    if id is None or not (0 < int(m[2]) < 2**32 and 0 < int(m[3]) < 2**32):
        return None
    return id, int(m[2]), int(m[3])


@dataclass
class Engine:
    """Queries over ``graph``; ``root`` is what shown paths are relative to."""

    spark: SparkSession
    graph: Graph
    root: str = ""
    generation: int = 0
    counters: dict[str, int] = field(default_factory=lambda: {"queries": 0, "query_ms": 0})

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Engine | None:
        saved = store.GraphStore(spark, folder)
        graph = saved.load()
        return graph and cls(spark, graph, saved.meta().get("root_path", ""), saved.generation())

    @classmethod
    def index(cls, spark: SparkSession, tree: str, folder: str, forced: bool = False) -> Engine:
        """Brings the stored graph up to date with a source tree: new and changed files are read, gone ones leave."""
        began = time.monotonic()
        saved, scanned = store.GraphStore(spark, folder), scan_tree(spark, tree)
        old = saved.load()
        empty = lambda kind: spark.createDataFrame([], kind)
        before = old or Graph(empty(store.SYMBOLS), empty(store.EDGES), empty(store.PENDING), empty(store.FILES))
        stale = store.stale_files(scanned, before.files, forced or old is None)
        found, found_pending, found_files = extract_files(stale)
        leave = stale.select("path").unionByName(store.deleted_files(scanned, before.files).select("path"))
        keep = lambda rows, column: rows.join(leave.withColumnRenamed("path", column), column, "left_anti").select(*rows.columns)
        symbols = keep(before.symbols, "file").unionByName(found)
        pending = keep(before.pending, "caller_file").unionByName(found_pending)
        files = keep(before.files, "path").unionByName(found_files)
        errors = found_files.agg(F.sum("error_count")).first()[0] or 0
        counted = lambda edges: store.index_counters(found_files, found, edges, errors, int(1000 * (time.monotonic() - began)))
        saved.save(Graph(symbols, resolved_edges(pending, symbols), pending, files), counted, root_path=tree)
        return cls.open(spark, folder)

    # queries

    def seeds(self, kind: str, text: str) -> DataFrame:
        g = self.graph
        if kind == "file":
            path = text if text.startswith("/") or not self.root else f"{self.root}/{text}"
            return index.top(index.file_anchor_scores(g.symbols, path))
        if kind == "symbol":
            return index.top(index.symbol_anchor_scores(g.symbols, text))
        return index.task_seeds(g.symbols, g.edges, text)

    def collected(self, kind: str, text: str, budget: int = K.MOST_SET) -> DataFrame:
        """The set for a task, symbol or file query: the columns of symbols, score and reason, in order."""
        found = retrieve.collected(self.graph.symbols, self.graph.edges, self.seeds(kind, text), budget)
        return retrieve.with_symbols(found, self.graph.symbols)

    def retrieve(self, kind: str, text: str, detail: str = "compact") -> str:
        """The packet of a query.  Any detail but ``full`` is compact."""
        if not text:
            return "ERROR: invalid request\n"
        began = time.monotonic()
        found = self.collected(kind, text).collect()  # at most the budget
        self.counters["queries"] += 1
        if not found:
            return f"ERROR: no symbols found for query: {text}\n"
        g, one = self.graph, self.spark.range(1)
        terms, asked = one.select(T.terms(F.lit(text)), T.intent(F.lit(text))).first()
        intent = asked if kind == "task" else "trace"
        ids = lambda rows: self.spark.createDataFrame([(s.id,) for s in rows], "id bigint")
        files = self.spark.createDataFrame([(f,) for f in dict.fromkeys(s.file for s in found)], "file string")
        if detail == "full":
            groups: dict[int, dict[str, str]] = {}
            for r in retrieve.edge_groups(ids(found), g.edges, g.symbols).collect():
                groups.setdefault(r.id, {})[r.edge_group] = r.names
            peers: dict[str, list[str]] = {}
            for r in retrieve.dir_peers(files, g.symbols).orderBy("file", "place").collect():
                peers.setdefault(r.file, []).append(r.peer)
            out = render.full(text, terms, found, groups, peers, self.root)
        else:
            hints = {r.file: r.hints for r in retrieve.entrypoint_hints(files, g.symbols, T.terms(F.lit(text))).collect()}
            out = render.packet(text, intent, terms, found, hints, self._cards(found[: K.PACKET_CARDS], intent), self.root)
        self.counters["query_ms"] += int((time.monotonic() - began) * 1000)
        return out

    def _cards(self, rows: list, intent: str) -> list[str]:
        g = self.graph
        ids = self.spark.createDataFrame([(s.id,) for s in rows], "id bigint")
        near: dict[int, list] = {}
        for r in retrieve.card_relations(ids, g.edges, g.symbols).orderBy("id", "place").collect():
            near.setdefault(r.id, []).append(r)
        first = retrieve.relations(g.edges, g.symbols, ids).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min_by(S.handle_prefix(F.col("kind"), F.col("outgoing")), F.struct("seq", "other_id")).alias("prefix"))
        every = {r.id: r for r in first.collect()}
        out = []
        for s in rows:
            shown = near.get(s.id, [])
            more = every[s.id].prefix if s.id in every and min(every[s.id].n, 64) > len(shown) else None
            out.append(render.card(s, shown, more, intent, self.root))
        return out

    # handles

    def _symbol(self, id: int):
        return self.graph.symbols.where(F.col("id") == id).withColumns({"score": F.lit(0.0), "reason": F.lit("expanded")}).first()

    def _path(self, value: str) -> str:
        return value if value.startswith("/") or not self.root else f"{self.root}/{value}"

    def expand(self, handle: str) -> str:
        """The text behind ``expand:<kind>:<value>``."""
        m = re.match(r"expand:([^:]*):(.*)$", handle or "", re.S)
        if not m:
            return "ERROR: invalid expansion handle\n"
        kind, value, g = m[1], m[2], self.graph
        if kind == "file":
            path = self._path(value)
            rows = expand.file_map(g.symbols, path).orderBy("section", "place").collect()
            return render.file_expansion(path, rows, expand.file_totals(g.symbols, path).first(), self.root)
        if kind == "entrypoints":
            path = self._path(value)
            total = g.symbols.where((F.col("file") == path) & S.is_public_entrypoint()).count()
            return render.entrypoint_expansion(path, expand.entrypoints(g.symbols, path).collect(), total, self.root)
        asked = parse_lines(value) if kind == "lines" else None
        if kind == "lines" and asked is None:
            return "ERROR: invalid line expansion handle\n"
        id = asked[0] if asked else parse_id(value)
        if id is None:
            return "ERROR: invalid expansion id\n"
        s = self._symbol(id)
        if s is None:
            return f"ERROR: symbol not found for handle: {handle}\n"
        if kind == "symbol":
            return "CTX_EXPANSION\n" + self._cards([s], "trace")[0]
        if kind in ("source", "lines"):
            last = max(s.end_line, s.line)
            start, end = (max(asked[1], s.line), min(asked[2], last)) if asked else (s.line, last)
            return self._source(s.file, start, max(end, start), "source_ranges" if asked else "source_bodies")
        if kind in RELATIONS:
            title, edge, direction = RELATIONS[kind]
            rows = expand.related(g.symbols, g.edges, id, edge, direction).orderBy("seq", unsigned(F.col("other_id"))).collect()
            return render.relation_expansion(title, id, rows, self.root)
        return "ERROR: unknown expansion handle kind\n"

    def _source(self, path: str, start: int, end: int, counted: str) -> str:
        data = read_source(path)
        if data is None:
            out = f"ERROR: cannot open source file: {path}\n"
        else:
            lines = data.decode("utf-8", "replace").split("\n")[start - 1 : end]
            out = f"SOURCE {render.shown_path(self.root, path)}:{start}-{end}\n" + "".join(f"{n:5d} | {text}\n" for n, text in enumerate(lines, start))
        return out + f"ACCOUNTING\n- {counted}: 1\n- estimated_output_tokens: {render.token_estimate(out)}\n"

    # lists, projections, state

    def list_symbols(self, query: str = "", page: int = 0) -> tuple[DataFrame, int, int]:
        return listing.page(listing.symbol_rows(self.graph.symbols, query), page, "seq", "id")

    def list_calls(self, query: str = "", page: int = 0) -> tuple[DataFrame, int, int]:
        return listing.page(listing.call_rows(self.graph.symbols, self.graph.edges, query), page, "seq", "from_id", "to_id")

    def list_files(self, query: str = "", page: int = 0) -> tuple[DataFrame, int, int]:
        return listing.page(listing.file_rows(self.graph.files, self.graph.symbols, query), page, "path")

    def project(self, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        nodes = project.placed(project.project_nodes(self.graph.symbols, self.graph.edges), before)
        return nodes, project.project_edges(self.graph.edges, nodes)

    def status(self, counts: bool = True) -> str:
        state = {"status": "ready", "ready": True, "graph_generation": self.generation}
        if counts:
            g = self.graph
            state |= {"files": g.files.count(), "symbols": g.symbols.count(), "edges": g.edges.count(), "errors": g.files.agg(F.coalesce(F.sum("error_count"), F.lit(0))).first()[0]}
        return json.dumps(state | self.counters)
