"""Expansion of seeds through the graph, and the budgeted set that a query returns.

Everything is kept per stage as (id, stage, place, score, reason); the set keeps the first ``budget`` distinct ids by
stage and place, and each kept id has the best score that any stage gave it, with the reason of the first that did.
A level of the expansion holds at most ``budget`` new symbols for each seed: later ones could not enter the set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.functions import symbols as S
from lodestrand.functions.hashing import unsigned
from lodestrand.functions.paths import basename, dirname, is_vendor
from lodestrand.operators.index import adjacency
from lodestrand.operators.scratch import Scratch

LIST_IDS = 1024
PIECE_RANKS = 1 << 14


def ranked_seeds(seeds: DataFrame) -> DataFrame:
    """rank, id, score by score and unsigned id.  Seeds are at most ``MOST_SEEDS`` rows, so one window holds them."""
    return seeds.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), unsigned(F.col("id")))).cast("bigint"))


def relations(edges: DataFrame, symbols: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The edges at each of ``ids``, or at all symbols, with the symbol at the other end; ends without one, or of unknown kind, are left out.
    The edges are cut down to those of ``ids`` first; nothing is broadcast but by the planner, which knows the sizes."""
    other = symbols.where(F.col("kind") != K.UNKNOWN).select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("file").alias("other_file"), F.col("line").alias("other_line"), F.col("kind").alias("other_kind"))
    ends = adjacency(edges) if ids is None else adjacency(edges).join(ids.select("id"), "id", "left_semi")
    return ends.join(other, "other_id")


def levels(starts: DataFrame, symbols: DataFrame, edges: DataFrame, depth: int = K.DEPTH, budget: int = K.MOST_SET) -> DataFrame:
    """Arrivals of a breadth-first search from each start: rank, level, id, outgoing, place.

    ``starts`` has rank and id.  References are followed outwards only, and never from a start outside vendor folders
    into them.  All arrivals are returned; only symbols new to their start are searched on.
    """
    scratch = Scratch(symbols.sparkSession, "walk")  # each level is written: later ones start from it
    ways = adjacency(edges).where(~((F.col("kind") == K.REFERENCES) & ~F.col("outgoing"))).withColumnRenamed("id", "at")
    other = symbols.where(F.col("kind") != K.UNKNOWN).select(F.col("id").alias("other_id"), is_vendor(F.col("file")).alias("into_vendor"))
    home = symbols.select("id", is_vendor(F.col("file")).alias("from_vendor"))
    frontier = starts.select("rank", "id").join(home, "id").select("rank", F.col("id").alias("at"), "from_vendor", F.lit(0).cast("bigint").alias("parent"))
    frontier = scratch.write(frontier, "start")
    visited, found = frontier.select("rank", F.col("at").alias("id")), None
    for level in range(1, depth + 1):
        # the frontier is at most ``budget`` rows a start, so the edges are scanned and not shuffled
        reached = ways.join(F.broadcast(frontier), "at").join(other, "other_id").where(~((F.col("kind") == K.REFERENCES) & ~F.col("from_vendor") & F.col("into_vendor")))
        # newest edges first, as they are added in front of older ones
        place = F.array(F.lit(level).cast("bigint"), F.col("parent"), -F.col("seq"), unsigned(F.col("other_id")))
        reached = reached.groupBy("rank", F.col("other_id").alias("id"), "outgoing").agg(F.min(place).alias("place"), F.first("from_vendor").alias("from_vendor"))
        reached = scratch.write(reached.withColumn("level", F.lit(level)), f"reached-{level}")
        found = reached if found is None else found.unionByName(reached)
        if level == depth:
            break
        fresh = reached.groupBy("rank", "id").agg(F.min("place").alias("place"), F.first("from_vendor").alias("from_vendor")).join(visited, ["rank", "id"], "left_anti")
        order = F.row_number().over(Window.partitionBy("rank").orderBy("place"))
        fresh = scratch.write(fresh.withColumn("parent", order.cast("bigint")).where(F.col("parent") <= budget), f"fresh-{level}")
        frontier = fresh.select("rank", F.col("id").alias("at"), "from_vendor", "parent")
        visited = visited.unionByName(fresh.select("rank", "id"))
    return found.select("rank", "level", "id", "outgoing", "place")


def siblings(starts: DataFrame, symbols: DataFrame, skip: DataFrame | None = None, most: int = K.SIBLINGS) -> DataFrame:
    """rank, id, is_public, place of symbols in the file of each start, public entrypoints first, ``most`` of each
    start; ``skip`` has ids that do not count."""
    of = starts.select("rank", "id").join(symbols.select("id", "file"), "id").withColumnRenamed("id", "start_id")
    mates = of.join(symbols.where(F.col("kind") != K.UNKNOWN), "file").where("id <> start_id")
    if skip is not None:
        mates = mates.join(skip.select("id"), "id", "left_anti")
    public = S.is_public_entrypoint()
    # a symbol belongs to the first start that reaches it
    mates = mates.select("id", "rank", public.alias("is_public"), "seq").withColumn("first", F.min("rank").over(Window.partitionBy("id"))).where("rank = first").drop("first")
    order = F.row_number().over(Window.partitionBy("rank").orderBy(F.desc("is_public"), "seq", "id"))
    return mates.withColumn("place", order).where(F.col("place") <= most).select("rank", "id", "is_public", "place")


def include_chain(starts: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """rank, id: symbols in the files that each start includes, vendor files aside.

    The result may have as many rows as starts times symbols, so it is the last step that makes them, and none of them is
    shuffled or stored: repeats go from ranks and files, and from files and ids, before these meet.  A file meets its ids
    in lists of about ``LIST_IDS``, and its ranks in pieces of about ``PIECE_RANKS``, each with the file's lists beside it.
    """
    known = symbols.where(F.col("kind") != K.UNKNOWN)
    included = known.where(~is_vendor(F.col("file"))).select(F.col("id").alias("to_id"), "file")
    links = edges.where(F.col("kind") == K.INCLUDES).select(F.col("from_id").alias("start_id"), "to_id")
    files = starts.select("rank", F.col("id").alias("start_id")).join(links, "start_id").join(included, "to_id").select("rank", "file").distinct()
    files = Scratch(symbols.sparkSession, "included").write(files, "files")
    pieces = files.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / PIECE_RANKS).alias("pieces"))
    homes = known.groupBy("id").agg(F.min("file").alias("file"), F.max("file").alias("last"))
    single = homes.where("file = last").select("id", "file")
    sizes = single.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / LIST_IDS).alias("lists"))
    lists = single.join(pieces.join(sizes, "file"), "file").groupBy("file", "pieces", F.pmod(F.xxhash64("id"), "lists").alias("list")).agg(F.collect_list("id").alias("ids"))
    lists = lists.select("file", "ids", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"))
    ranks = files.join(pieces, "file").select("rank", "file", F.pmod(F.xxhash64("rank"), "pieces").alias("piece"))
    # merged by file, so that rows with the same ids follow each other and are stored in little room
    found = ranks.join(lists.hint("merge"), ["file", "piece"]).select("rank", F.explode("ids").alias("id"))
    # an id that stands in several files may be reached through each of them
    several = known.select("id", "file").distinct().join(homes.where("file <> last").select("id"), "id", "left_semi")
    return found.unionByName(files.join(several, "file").select("rank", "id").distinct())


def file_entrypoints(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """place, id, seq of public entrypoints in the given files (file, place)."""
    return symbols.where(S.is_public_entrypoint()).select("id", "file", "seq").join(files, "file").select("place", "id", "seq")


def dir_peers(files: DataFrame, symbols: DataFrame, most: int = K.DIR_PEERS) -> DataFrame:
    """file, peer, place: names of other files in the directory of each file, in order of first symbol."""
    every = symbols.where(F.col("kind") != K.UNKNOWN).groupBy("file").agg(F.min("seq").alias("seq"))
    others = every.where(~is_vendor(F.col("file"))).select(F.col("file").alias("other"), dirname(F.col("file")).alias("dir"), basename(F.col("file")).alias("peer"), "seq")
    # a directory's first names, one more than a file can use: its own may be among them
    rank = F.row_number().over(Window.partitionBy("dir").orderBy("seq", "peer"))
    firsts = others.where("dir <> ''").withColumn("rank", rank).where(F.col("rank") <= most + 1)
    pairs = files.select("file", dirname(F.col("file")).alias("dir")).distinct().join(firsts, "dir").where("other <> file")
    place = F.row_number().over(Window.partitionBy("file").orderBy("seq", "peer"))
    return pairs.withColumn("place", place).where(F.col("place") <= most).select("file", "peer", "place")


def _kept(stages: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` distinct ids: id, order."""
    first = stages.groupBy("id").agg(F.min(F.struct("stage", "place")).alias("first"))
    return first.orderBy("first", "id").limit(budget)


def collected(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, budget: int = K.MOST_SET, depth: int = K.DEPTH) -> DataFrame:
    """id, score, reason of the set for ``seeds`` (id, score).  Seeds that fill the budget leave no room for others."""
    scratch = Scratch(symbols.sparkSession, "collected")
    starts = scratch.write(ranked_seeds(seeds), "starts")  # at most MOST_SEEDS rows, used by every stage
    none = F.lit(0).cast("bigint")
    stages = starts.select("id", F.lit(1).alias("stage"), F.array("rank").alias("place"), "score", F.lit("query match").alias("reason"))
    if starts.count() < budget:
        walk = levels(starts, symbols, edges, depth, budget)
        score = F.element_at(F.array(*[F.lit(s) for s in K.HOP_SCORES]), F.col("level"))
        reason = F.when(F.col("outgoing"), "callee").otherwise("caller")
        walk = walk.select("id", F.lit(2).alias("stage"), F.concat(F.array("rank"), "place").alias("place"), score.alias("score"), reason.alias("reason"))
        # of all arrivals of a symbol only the first, and the best score of each reason, matter
        walk = walk.groupBy("id", "stage", "score", "reason").agg(F.min("place").alias("place")).select("id", "stage", "place", "score", "reason")
        stages = scratch.write(stages.unionByName(walk), "walked")
        top = starts.where(F.col("rank") <= K.SEED_SPREAD)
        near = siblings(top, symbols, stages.select("id").distinct())
        score = F.when(F.col("is_public"), K.SIBLING_PUBLIC).otherwise(K.SIBLING_OTHER)
        near = near.select("id", F.lit(3).alias("stage"), F.array(F.col("rank"), F.col("place").cast("bigint")).alias("place"), score.alias("score"), F.when(F.col("is_public"), "co-file entrypoint").otherwise("co-file").alias("reason"))
        chain = include_chain(top, symbols, edges).select("id", F.lit(4).alias("stage"), F.array("rank", unsigned(F.col("id"))).alias("place"), F.lit(K.INCLUDE_CHAIN).alias("score"), F.lit("include-chain").alias("reason"))
        stages = scratch.write(stages.unionByName(near).unionByName(chain), "around")
        so_far = _kept(stages, budget).join(symbols.select("id", "file"), "id")
        files = so_far.groupBy("file").agg(F.min("first").alias("first")).orderBy("first", "file").limit(K.ENTRYPOINT_FILES)
        files = files.withColumn("place", F.row_number().over(Window.orderBy("first", "file")).cast("bigint")).select("file", "place")
        entries = file_entrypoints(files, symbols).select("id", F.lit(5).alias("stage"), F.array("place", "seq", none).alias("place"), F.lit(K.ENTRYPOINT_SCORE).alias("score"), F.lit("file entrypoint").alias("reason"))
        stages = scratch.write(stages.unionByName(entries), "stages")
    kept = F.broadcast(_kept(stages, budget).select("id"))
    # the best score; of equal ones the reason that came first
    best = F.max_by(F.struct("score", "reason"), F.struct(F.col("score"), -F.col("stage"), F.transform("place", lambda p: -1 - p)))
    return stages.join(kept, "id").groupBy("id").agg(best.alias("best")).select("id", "best.score", "best.reason")


def with_symbols(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """The set in its order, with the columns of its symbols."""
    return symbols.join(F.broadcast(found), "id").orderBy(F.desc("score"), unsigned(F.col("id")))


def modules_of(found: DataFrame, most: int = 64) -> DataFrame:
    """module, n_symbols, lang, first: modules of a set by where they first appear; ``found`` has rank, file, lang."""
    rows = found.select(dirname(F.col("file")).alias("module"), "rank", "lang")
    return rows.groupBy("module").agg(F.count(F.lit(1)).alias("n_symbols"), F.min_by("lang", "rank").alias("lang"), F.min("rank").alias("first")).orderBy("first").limit(most)


def files_of(found: DataFrame) -> DataFrame:
    """module, file, n_symbols, lang, module_place, file_place: files by first appearance inside modules by theirs."""
    rows = found.select(dirname(F.col("file")).alias("module"), "file", "rank", "lang")
    files = rows.groupBy("module", "file").agg(F.count(F.lit(1)).alias("n_symbols"), F.min_by("lang", "rank").alias("lang"), F.min("rank").alias("first"))
    files = files.withColumn("module_first", F.min("first").over(Window.partitionBy("module")))
    place = F.dense_rank().over(Window.orderBy("module_first"))  # a set is at most MOST_SET rows
    inner = F.row_number().over(Window.partitionBy("module").orderBy("first"))
    return files.select("module", "file", "n_symbols", "lang", place.alias("module_place"), inner.alias("file_place"))


def card_relations(ids: DataFrame, edges: DataFrame, symbols: DataFrame, most: int = K.PACKET_RELATIONS) -> DataFrame:
    """The first relations of each symbol that are shown: id, place, outgoing, other_*, and whether there are more."""
    near = relations(edges, symbols, ids)
    order = Window.partitionBy("id").orderBy("shown_last", "seq", "other_id", "outgoing", "kind")
    hidden = (F.col("kind") == K.REFERENCES) & ~F.col("outgoing")
    rows = near.withColumn("shown_last", hidden).withColumn("place", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("id")))
    shown = rows.where(~F.col("shown_last") & (F.col("place") <= most))
    return shown.select("id", "place", "outgoing", "kind", "other_name", basename(F.col("other_file")).alias("other_base"), "other_line", (F.col("total") > F.count(F.lit(1)).over(Window.partitionBy("id"))).alias("more"))


def edge_groups(ids: DataFrame, edges: DataFrame, symbols: DataFrame, most: int = 6) -> DataFrame:
    """id, edge_group, names: the first relations of each kind and direction, as text."""
    own = symbols.select("id", F.col("file").alias("own_file"))
    near = relations(edges, symbols, ids).join(own, "id")
    rows = near.withColumn("edge_group", S.edge_group(F.col("kind"), F.col("outgoing"))).where("edge_group is not null")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("id", "edge_group").orderBy("seq", "other_id", "outgoing"))).where(F.col("place") <= most)
    where = F.when(F.col("other_file") == F.col("own_file"), F.concat(F.lit(":"), F.col("other_line"))).otherwise(F.concat(F.lit("("), basename(F.col("other_file")), F.lit(":"), F.col("other_line"), F.lit(")")))
    text = F.struct("place", F.concat("other_name", where).alias("text"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["text"]), ", ")
    return rows.groupBy("id", "edge_group").agg(names.alias("names"))


def entrypoint_hints(files: DataFrame, symbols: DataFrame, terms: Column, most: int = 3) -> DataFrame:
    """file, hints: public entrypoints of each file, those that match a term first."""
    rows = symbols.where(S.is_public_entrypoint()).join(files.select("file"), "file")
    hit = F.exists(terms, lambda t: F.lower("name").contains(t) | F.lower("signature").contains(t))
    rows = rows.select("file", "name", "seq", "id", hit.alias("hit"))
    place = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("hit"), "seq", "id"))
    rows = rows.withColumn("place", place).where(F.col("place") <= most)
    names = F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"])
    return rows.groupBy("file").agg(F.array_join(names, ",").alias("hints"))
