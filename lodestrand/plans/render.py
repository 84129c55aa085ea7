"""Text of packets, cards and expansions; what is rendered is bounded by the set's budget and already on the driver."""

from __future__ import annotations

from lodestrand.functions import constants as K


def shown_path(root: str, path: str) -> str:
    if not root:
        return path
    return "." if path == root else path[len(root) + 1 :] if path.startswith(root + "/") else path


def unsigned(id: int) -> int:
    return id & (2**64 - 1)


def is_vendor(path: str) -> bool:
    return any(f"/{d}/" in path for d in K.VENDOR_DIRS)


def module_of(path: str) -> str:
    return path.rsplit("/", 1)[0] if "/" in path else ""


def token_estimate(text: str) -> int:
    return len(text.encode()) // 4 + 1


def span(s) -> str:
    return f"{s.line}-{s.end_line}" if s.end_line > s.line else f"{s.line}"


def edit_target(intent: str, s) -> bool:
    if s.kind in (K.INCLUDE, K.UNKNOWN):
        return False
    asked = s.reason == "query match"
    return s.score >= 40 or asked if intent in ("edit", "debug", "review") else asked and s.score >= 80


def card(s, relations: list, more: str | None, intent: str, root: str) -> str:
    """One symbol card; ``relations`` are the shown ones, ``more`` the handle for the rest."""
    signature = f"({s.signature})" if s.signature and s.kind != K.UNKNOWN else ""
    out = [f"- {K.KIND_LABELS[s.kind]}       {s.name}{signature}  {shown_path(root, s.file)}:{span(s)}  score={s.score:.1f}{'  edit-target' if edit_target(intent, s) else ''}"]
    out.append(f"  role: {s.reason}{f' in {s.scope}' if s.scope else ''}{' vendor-penalized' if is_vendor(s.file) else ''}")
    out += [f"  relation: {'out' if r.outgoing else 'in'} {r.other_name} {r.other_base}:{r.other_line}" for r in relations]
    if more:
        out.append(f"  more: {more}:{unsigned(s.id)}")
    out.append(f"  expand: expand:symbol:{unsigned(s.id)} | expand:source:{unsigned(s.id)}")
    return "\n".join(out) + "\n"


def packet(text: str, intent: str, terms: list[str], found: list, hints: dict[str, str], cards: list[str], root: str) -> str:
    """The compact packet: map of the answer, edit targets, files, cards, what was left out, and accounting."""
    modules = list(dict.fromkeys(module_of(s.file) for s in found))[:64]
    out = ["CTX_PACKET\n", f"CODEBASE: {root}\n" if root else "", f"QUERY: {text}\n", f"INTENT: {intent}\n", "DETAIL: compact-adaptive\n", "TERMS:", *[f" {t}" for t in terms], "\n\n"]
    out += [
        f"ANSWER_MAP\n- retrieved_symbols: {len(found)}\n- represented_modules: {len(modules)}\n",
        "- source_policy: source bodies omitted by default; use expand:source:<id> for exact code\n",
        "- expansion_handles: stable per current index generation; each response remains self-contained\n\n",
    ]
    targets = [s for s in found if edit_target(intent, s)][: K.PACKET_TARGETS]
    out.append("EDIT_TARGETS\n")
    out += [f"- {K.KIND_LABELS[s.kind]} {s.name}  {shown_path(root, s.file)}:{s.line}  expand:source:{unsigned(s.id)}\n" for s in targets] or ["- none confidently identified; inspect top symbol cards\n"]
    ordered = list(dict.fromkeys(s.file for s in found))
    files = [f for m in modules for f in ordered if module_of(f) == m][: K.PACKET_FILES]
    out.append("\nRELEVANT_FILES\n")
    for f in files:
        shown = shown_path(root, f)
        out.append(f"- {shown}  module={shown_path(root, module_of(f))}  expand:entrypoints:{shown} | expand:file:{shown}{f'  entrypoints={hints[f]}' if hints.get(f) else ''}\n")
    out += ["\nSYMBOL_CARDS\n", *cards, "\nOMITTED_EXPANDABLE\n"]
    rest = found[len(cards) :]
    if rest:
        out.append(f"- symbols_omitted: {len(rest)}\n")
        out += [f"- {K.KIND_LABELS[s.kind]} {s.name}  {shown_path(root, s.file)}:{s.line}  expand:symbol:{unsigned(s.id)}\n" for s in rest[: K.PACKET_OMITTED]]
    else:
        out.append("- none\n")
    body = "".join(out) + "\nACCOUNTING\n"
    return body + f"- estimated_output_tokens: {token_estimate(body)}\n- symbol_cards: {len(cards)}\n- files_represented: {len(files)}\n- source_bodies: 0\n- expandable_handles: {len(found) + len(files)}\n- largest_section: SYMBOL_CARDS\n"


def symbol_line(s) -> str:
    signature = f"({s.signature})" if s.signature and s.kind != K.UNKNOWN else ""
    return f"    {K.KIND_LABELS[s.kind]:<8} {s.name}{signature}  :{span(s)}\n"


def full(text: str, terms: list[str], found: list, groups: dict[int, dict[str, str]], peers: dict[str, list[str]], root: str) -> str:
    """Every symbol by module and file, with its relations by kind."""
    modules = list(dict.fromkeys(module_of(s.file) for s in found))[:64]
    out = [f"CODEBASE: {root}\n" if root else "", f"QUERY: {text}\n", "TERMS:", *[f" {t}" for t in terms], f"\nSYMBOLS: {len(found)} across {len(modules)} modules\n\nMODULES:\n"]
    for m in modules:
        own = [s for s in found if module_of(s.file) == m]
        also = peers.get(own[0].file, [])
        out.append(f"  {m}/  {len(own)} syms  {K.LANG_LABELS[own[0].lang]}{f'  [also: {", ".join(also)}]' if also else ''}\n")
    out.append("\n")
    for m in modules:
        out.append(f"MODULE {m}/\n")
        for f in list(dict.fromkeys(s.file for s in found if module_of(s.file) == m))[:64]:
            own = [s for s in found if s.file == f]
            out.append(f"  FILE {f}  [{len(own)} syms, {K.LANG_LABELS[own[0].lang]}]\n")
            for s in own:
                out.append(symbol_line(s))
                out += [f"      {g}: {groups[s.id][g]}\n" for g in K.EDGE_GROUPS if g in groups.get(s.id, {})]
            out.append("\n")
    return "".join(out)


def expansion_row(s, root: str) -> str:
    signature = f"({s.signature})" if s.signature else ""
    return f"- {K.KIND_LABELS[s.kind]} {s.name}{signature}  {shown_path(root, s.file)}:{span(s)}  expand:symbol:{unsigned(s.id)} expand:source:{unsigned(s.id)}\n"


def file_expansion(path: str, rows: list, totals, root: str) -> str:
    out = f"CTX_EXPANSION\nFILE: {shown_path(root, path)}\nDETAIL: compact-file-map\nSOURCE_POLICY: no source bodies; use expand:source:<id> for exact code\n\n"
    section = lambda name: [expansion_row(s, root) for s in rows if s.section == name]
    out += "ENTRYPOINTS\n" + ("".join(section("entrypoint")) or "- none\n") + "\nINTERNAL_SYMBOLS\n" + ("".join(section("internal")) or "- none\n") + "\nOMITTED_EXPANDABLE\n"
    out += f"- symbols_omitted: {totals.omitted}\n" + "".join(section("omitted")) if totals.omitted else "- none\n"
    out += f"\nACCOUNTING\n- symbols_total: {totals.total}\n- entrypoints_total: {totals.entrypoints}\n- internal_symbols_total: {totals.internals}\n- symbols_listed: {totals.listed}\n- symbols_omitted: {totals.omitted}\n"
    return out + f"- bytes_before_accounting: {len(out.encode())}\n- estimated_output_tokens: {token_estimate(out)}\n"


def entrypoint_expansion(path: str, rows: list, total: int, root: str) -> str:
    shown = shown_path(root, path)
    out = f"CTX_EXPANSION\nFILE: {shown}\nDETAIL: entrypoints-only\n\n" + "".join(expansion_row(s, root) for s in rows)
    if not total:
        out += "- none; use expand:file:<path> for the compact file symbol map\n"
    if total > len(rows):
        out += f"- entrypoints_omitted: {total - len(rows)}; use expand:file:{shown} for additional handles\n"
    out += f"\nACCOUNTING\n- entrypoints_total: {total}\n- entrypoints_listed: {len(rows)}\n"
    return out + f"- bytes_before_accounting: {len(out.encode())}\n- estimated_output_tokens: {token_estimate(out)}\n"


def relation_expansion(title: str, id: int, rows: list, root: str) -> str:
    out = f"CTX_EXPANSION\n{title}: {unsigned(id)}\n"
    out += "".join(f"- {K.KIND_LABELS[r.other_kind]} {r.other_name}  {shown_path(root, r.other_file)}:{r.other_line}  expand:symbol:{unsigned(r.other_id)}\n" for r in rows)
    return out + f"ACCOUNTING\n- relations: {len(rows)}\n- estimated_output_tokens: {token_estimate(out)}\n"
