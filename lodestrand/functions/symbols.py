"""Predicates, labels and scores over the columns of symbols and edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions import constants as K
from lodestrand.functions.paths import basename, is_vendor


def _lookup(code: Column, values: tuple, otherwise) -> Column:
    table = F.array(*[F.lit(v) for v in values])
    return F.when((code >= 0) & (code < len(values)), F.get(table, code)).otherwise(F.lit(otherwise))


def kind_label(kind: Column) -> Column:
    return _lookup(kind, K.KIND_LABELS, "node")


def kind_list_label(kind: Column) -> Column:
    return _lookup(kind, K.KIND_LIST_LABELS, "?")


def kind_importance(kind: Column) -> Column:
    return _lookup(kind, K.KIND_IMPORTANCE, 0)


def kind_resolution(kind: Column) -> Column:
    return _lookup(kind, tuple(K.KIND_RESOLUTION.get(k, 0) for k in range(11)), 0)


def edge_label(kind: Column) -> Column:
    return _lookup(kind, K.EDGE_LABELS, "calls")


def lang_label(lang: Column) -> Column:
    return _lookup(lang, K.LANG_LABELS, "unknown")


def lang_short(lang: Column) -> Column:
    return _lookup(lang, K.LANG_SHORT, "?")


def has_static_marker(signature: Column) -> Column:
    return F.lower(signature).rlike("static[ \t]")


def has_public_prefix(name: Column, prefixes: tuple[str, ...] = K.PUBLIC_PREFIXES) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | name.startswith(p)
    return out


def is_public_entrypoint() -> Column:
    c = F.col
    callable_ = c("kind").isin(K.FUNCTION, K.METHOD) & (c("end_line") > c("line"))
    type_ = c("kind").isin(K.CLASS, K.STRUCT, K.ENUM, K.TYPEDEF) & c("is_definition")
    return ~is_vendor(c("file")) & (c("scope") == "") & ~has_static_marker(c("signature")) & (callable_ | type_)


def is_edit_target(intent: Column) -> Column:
    """Over the columns kind, score and reason."""
    c, asked = F.col, F.col("reason") == "query match"
    active = intent.isin("edit", "debug", "review")
    return ~c("kind").isin(K.INCLUDE, K.UNKNOWN) & F.when(active, (c("score") >= 40.0) | asked).otherwise(asked & (c("score") >= 80.0))


def hub_bonus(degree: Column) -> Column:
    return F.least(F.lit(12.0), F.coalesce(degree, F.lit(0)) * 0.15)


def token_score(token: Column, hub: Column, prefixes: tuple[str, ...] = K.PUBLIC_PREFIXES) -> Column:
    """What a token of a symbol is worth, over the symbol's columns."""
    c, name = F.col, F.lower(F.col("name"))
    base = F.when(name == token, 40.0).when(name.startswith(token), 22.0).when(F.lower(basename(c("file"))) == token, 10.0).otherwise(8.0)
    total = base + kind_importance(c("kind")) + hub
    total = total + F.when(c("is_definition"), 6.0).otherwise(0.0) + F.when(is_public_entrypoint(), 14.0).otherwise(0.0) + F.when(has_public_prefix(c("name"), prefixes), 6.0).otherwise(0.0)
    return F.when(is_vendor(c("file")), total * 0.3).otherwise(total)


def edge_group(kind: Column, outgoing: Column) -> Column:
    return (
        F.when((kind == K.CALLS) & outgoing, "calls")
        .when(kind == K.CALLS, "called-by")
        .when((kind == K.INCLUDES) & outgoing, "includes")
        .when(kind == K.INCLUDES, "included-by")
        .when(kind == K.DEFINES, "defines")
        .when((kind == K.REFERENCES) & outgoing, "refs")
        .when(kind == K.INHERITS, "inherits")
    )


def handle_prefix(kind: Column, outgoing: Column) -> Column:
    return F.when((kind == K.CALLS) & outgoing, "expand:callees").when(kind == K.CALLS, "expand:callers").when(kind == K.REFERENCES, "expand:refs").otherwise("expand:symbol")


def graph_kind_score(kind: Column) -> Column:
    return (
        F.when(kind.isin(K.FUNCTION, K.METHOD), 120)
        .when(kind.isin(K.CLASS, K.STRUCT), 110)
        .when(kind.isin(K.ENUM, K.TYPEDEF, K.NAMESPACE), 85)
        .when(kind == K.MACRO, 70)
        .otherwise(12)
    )
