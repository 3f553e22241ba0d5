"""One statement recorded in several layouts.

A statement is taken apart into pairs of field name and normalised value: attributes of the outer tag, selected
columns, assignments, inserted columns with their values, conditions joined by AND, and each remaining clause whole.
Selects and conditions in brackets are taken apart in the same way, from the innermost outwards, and stand in their
field as one value; CASE ... END is one value in its own order. Each pair is hashed, the hashes are added up modulo
2^128, so the order of listed fields does not matter and repeats count. Rows meet by this fingerprint alone; the fields
of groups of two or more are then verified, each row against the row with the smallest id of its group. Rows that
collided are grouped and verified again among themselves until none is left. Records are never sorted.

White space, comments, closing semicolons, quoting marks around identifiers and attribute values, and letter case
outside quoted literals, placeholders and attribute values are normalised away; everything else counts.

Defined cases: rows whose template is null, empty or without any content belong to no statement; a null and an empty
normalised text differ; rows with the same id are one row; unreadable markup is compared token by token.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from factloom.operators.skew_join import heavy, repeated, salted
from factloom.session import cut, cut_counted

_GAP = r"[\s\u200b\u200c\u200d\u2060\ufeff]"
_LEAD = regex.compile(rf"(?:{_GAP}+|<!--.*?-->|/\*.*?\*/|--[^\r\n]*(?:[\r\n]|$)|<\?.*?\?>|;)*", regex.S)
_XML = regex.compile(
    r"(?P<skip><!--.*?-->|<\?.*?\?>)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|</(?P<close>[\w:.-]+)\s*>"
    r"|<(?P<open>[\w:.-]+)(?P<attrs>(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<empty>/)?>|(?P<text>[^<]+|<)",
    regex.S,
)
_ATTRIBUTE = regex.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", regex.S)
# what is skipped before a token is atomic, so a comment is never taken apart for its signs
_SQL = re.compile(
    rf"(?>(?:{_GAP}+|<!--.*?-->|/\*.*?(?:\*/|\Z)|--[^\r\n]*)*)"
    r"(?:(?P<word>(?![0-9]|[$]\{)[\w$]+)|(?P<op>[,=.();<>!|:+*/%&^~?@\\{}-])|(?P<holder>[#$]\{[^}]*\}?)|(?P<literal>'(?:[^']|'')*'?)"
    r"|\"(?P<dq>[^\"]*)\"|`(?P<bq>[^`]*)`|\[(?P<sq>[^\]]*)\]"
    r"|(?P<number>\d+(?:\.\d+)?(?!\w))|(?P<mixed>[\w$]+)|(?P<other>.)|\Z)",
    re.S,
)
#: a value in brackets longer than this stands as its SHA-256
_LONG = 4096
#: operators of two signs
_TWO = {("<", ">"), ("<", "="), (">", "="), ("!", "="), ("|", "|"), (":", ":")}
_SPACES = regex.compile(rf"{_GAP}+")

#: fixed values: words that begin a clause
_CLAUSES = {"select", "from", "where", "set", "values", "group", "order", "having", "limit", "offset", "union", "intersect", "except", "insert", "update", "delete", "merge", "returning", "fetch", "for"}
_LIST_TAGS = {"where": "where", "set": "set"}
#: fixed values: words after which a square bracket quotes a name
_NO_NAMES = _CLAUSES | {"by", "as", "and", "or", "not", "on", "join", "into", "in", "is", "like", "between", "distinct", "all", "case", "when", "then", "else", "end", "using", "table", "asc", "desc"}

# a token is (kind, text): w word, q quoted identifier, l literal, p placeholder, n number, o operator, < tag opened, > tag closed;
# b is a bracket or CASE with what stands in it, (kind, text, tokens)
Token = tuple


def _sql_tokens(text: str) -> Iterator[Token]:
    sign, sign_end = "", -1
    name_end = -1  # where a name ended: a square bracket that follows it is a subscript
    for m in _SQL.finditer(text):
        kind = m.lastgroup
        if kind == "sq":
            if sign:
                yield "o", sign
                sign = ""
            if name_end >= 0 and (m.start("sq") - 1 == name_end or m["sq"].strip().isdecimal()):
                yield "o", "["
                yield from _sql_tokens(m["sq"])
                yield "o", "]"
            else:
                yield "q", m["sq"].strip().lower()
            name_end = m.end()
            continue
        name_end = -1
        if kind == "op":
            got = m["op"]
            # two signs that touch are one operator
            if sign:
                if m.start("op") == sign_end and (sign, got) in _TWO:
                    yield "o", sign + got
                    sign = ""
                    continue
                yield "o", sign
            sign, sign_end = "", -1
            if got in "<>!|:":
                sign, sign_end = got, m.end()
            else:
                yield "o", got
                name_end = m.end() if got == ")" else -1
            continue
        if sign:
            yield "o", sign
            sign = ""
        if kind == "word" or kind == "mixed":
            got = m[kind].lower()
            yield "w", got
            name_end = -1 if got in _NO_NAMES else m.end()
        elif kind == "holder":
            got = m["holder"]
            # a placeholder's name may hold blanks, what it is otherwise counts
            yield "p", _SPACES.sub("", got) if not got.isascii() or " " in got or not got.isprintable() else got
        elif kind == "literal" or kind == "number":
            yield kind[0], m[kind]
        elif kind in ("dq", "bq"):
            yield "q", m[kind].strip().lower()
            name_end = m.end()
        elif kind is not None:
            yield "o", m[kind].lower()
    if sign:
        yield "o", sign


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), _SPACES.sub(" ", unescape(m[2] if m[2] is not None else m[3])).strip()) for m in _ATTRIBUTE.finditer(text)]


def _xml_tokens(text: str) -> Iterator[Token]:
    held = ""  # adjoining texts are read together, so that a comment or CDATA mark cuts no token
    for m in _XML.finditer(text):
        if m["text"] is not None:
            held += unescape(m["text"])
        elif m["cdata"] is not None:
            held += m["cdata"]
        elif m["skip"] is not None:
            held += " "
        else:
            yield from _sql_tokens(held)
            held = ""
            if m["close"]:
                yield ">", m["close"].lower()
            else:
                yield "<", "\x1e".join([m["open"].lower(), *(f"{k}={v}" for k, v in _attributes(m["attrs"]))])
                if m["empty"]:
                    yield ">", m["open"].lower()
    yield from _sql_tokens(held)


def _render(tokens: list[Token]) -> str:
    return "\x1f".join([("<" + t[1] if t[0] == "<" else "</" + t[1] if t[0] == ">" else t[1]) for t in tokens])


def _bracket(opening: str, tokens: list[Token], clause: str) -> Token:
    """A bracket with its value: a select by its fields, conditions of a WHERE by branch, all else as it stands."""
    if tokens and tokens[0] == ("w", "select"):
        inner = "\x1d".join(sorted(f"{n}\x1c{v}" for n, v in _sql_fields(tokens)))
    elif clause == "where" and any(t[0] == "w" and t[1] == "and" for t in tokens):
        inner = "\x1d".join(f"{k}\x1c{v}" for k, v in sorted((k, _render(x)) for k, x in _conditions(tokens)))
    else:
        inner = _render(tokens)
    if len(inner) > _LONG:
        inner = hashlib.sha256(inner.encode()).hexdigest()
    return "b", f"{opening}\x1f{inner}\x1f{'end' if opening == 'case' else ')'}", tokens


def _unfolded(frames: list[list], last: list[Token]) -> list[Token]:
    out: list[Token] = []
    for opening, before, _ in frames:
        out += before
        out.append(("o" if opening == "(" else "w", opening))
    return out + last


def _fold(tokens: list[Token]) -> list[Token]:
    """Brackets and CASE ... END as one token each, from the innermost outwards and without recursion. What isn't closed
    stays as it is."""
    stack: list[list] = []  # (opening, tokens before it, clause around it)
    now: list[Token] = []
    clause, opened = "", 0
    for token in tokens:
        kind, text = token
        if (kind == "o" and text == "(") or (kind == "w" and text == "case"):
            stack.append([text, now, clause])
            now = []
            opened += text == "("
            clause = clause if text == "(" else ""
            continue
        if kind == "o" and text == ")" and opened:
            opened -= 1
            at = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "(")
            now = _unfolded(stack[at + 1 :], now)  # a CASE without its END
            del stack[at + 1 :]
            opening, before, around = stack.pop()
            before.append(_bracket(opening, now, around))
            now, clause = before, around
            continue
        if kind == "w":
            if text == "end" and stack and stack[-1][0] == "case":
                opening, before, clause = stack.pop()
                before.append(_bracket(opening, now, ""))
                now = before
                continue
            if text in _CLAUSES:
                clause = text
        elif kind == "<" and text == "where":
            clause = text
        elif kind == ">" and text == "where":
            clause = ""
        now.append(token)
    return _unfolded(stack, now)


def _items(tokens: list[Token], separator: str) -> list[list[Token]]:
    """Tokens between separators. Tags around an item go with it, so it can move with its conditions."""
    out: list[list[Token]] = []
    now: list[Token] = []
    around: list[Token] = []
    between, used = False, True
    for token in tokens:
        kind, text = token[0], token[1]
        if kind == "<" or kind == ">":
            if now:
                out.append([*around, *now])
                used, now = True, []
            if kind == "<":
                around.append(token)
                used = False
            elif around:
                if not used:
                    out.append([*around])
                    used = True
                around.pop()
        elif text == separator and kind in "wo" and not (between and separator == "and"):
            if now:
                out.append([*around, *now])
                used, now = True, []
        else:
            if kind == "w" and text in ("between", "and"):
                between = text == "between"
            now.append(token)
    if now:
        out.append([*around, *now])
    return out


def _conditions(tokens: list[Token]) -> list[tuple[int, list[Token]]]:
    """(branch, condition): branches are parted by OR and keep their order, conditions of one branch don't."""
    branch, out, now = 0, [], []
    for token in tokens:
        if token[0] == "w" and token[1] == "or":
            out += [(branch, x) for x in _items(now, "and")]
            branch, now = branch + 1, []
        else:
            now.append(token)
    return out + [(branch, x) for x in _items(now, "and")]


def _is_list(token: Token) -> bool:
    return token[0] == "b" and token[1][0] == "("


def _clauses(tokens: list[Token]) -> list[tuple[str, list[Token]]]:
    part: list[Token] = []
    out: list[tuple[str, list[Token]]] = [("", part)]
    tags = 0
    for token in tokens:
        kind, text = token[0], token[1]
        if kind == "w":
            if text in _CLAUSES and not tags:
                part = []
                out.append((text, part))
                continue
        elif kind == "<":
            name = text.split("\x1e")[0]
            if not tags and name in _LIST_TAGS:
                part = [token]
                out.append((_LIST_TAGS[name], part))
                tags = 1
                continue
            tags += tags > 0
        elif kind == ">":
            tags -= tags > 0
        part.append(token)
    return [(name, held) for name, held in out if name or held]


def _quantifier(part: list[Token]) -> int:
    """How many tokens before the selected columns say how many rows are meant."""
    words = [t[1] if t[0] == "w" else "" for t in part[:2]]
    if words[:1] == ["top"] and part[1:2] and part[1][0] in "nbp":
        return 2
    if words[:1] in (["distinct"], ["all"]):
        return 3 if words[1:] == ["on"] and part[2:3] and _is_list(part[2]) else 1
    return 0


def _sql_fields(tokens: list[Token]) -> list[tuple[str, str]]:
    """Fields of folded tokens."""
    while tokens and tokens[-1] == ("o", ";"):
        tokens = tokens[:-1]
    fields: list[tuple[str, str]] = []
    clauses = _clauses(tokens)
    fields.append(("shape", " ".join([name for name, _ in clauses])))
    columns: list[list[Token]] | None = None
    for k, (name, part) in enumerate(clauses):
        at = f"{name}{k}"
        following = clauses[k + 1][0] if k + 1 < len(clauses) else ""
        if name == "insert" and following in ("values", "select"):
            head = next((i for i, t in enumerate(part) if _is_list(t)), -1)
            if head >= 0:
                columns = _items(part[head][2], ",")
                fields.append((at, _render([*part[:head], ("o", "()"), *part[head + 1 :]])))
                continue
        if name in ("values", "select") and columns is not None:
            if name == "values":
                # rows, parted by commas; whatever follows them counts as it stands
                end = 0
                rows = []
                while end < len(part) and _is_list(part[end]):
                    rows.append(_items(part[end][2], ","))
                    end += 1
                    if part[end : end + 1] == [("o", ",")] and end + 1 < len(part) and _is_list(part[end + 1]):
                        end += 1
                rest = part[end:]
            else:
                start = _quantifier(part)
                rows, rest = [_items(part[start:], ",")], part[:start]
            if rest:
                fields.append((f"{at}.rest", _render(rest)))
            for r, row in enumerate(rows):
                if len(row) == len(columns):
                    fields += [(f"{at}.{r}", f"{_render(c)}\x1d{_render(v)}") for c, v in zip(columns, row)]
                else:
                    fields.append((f"{at}.{r}", "\x1d".join([*map(_render, columns), "", *map(_render, row)])))
            columns = None
        elif name == "select":
            start = _quantifier(part)
            if start:
                fields.append((f"{at}.quantifier", _render(part[:start])))
            fields += [(at, _render(x)) for x in _items(part[start:], ",")]
        elif name == "set":
            fields += [(at, _render(x)) for x in _items(part, ",")]
        elif name == "where":
            fields += [(f"{at}.{branch}", _render(x)) for branch, x in _conditions(part)]
        else:
            fields.append((at, _render(part)))
    return fields


def _taken_apart(text: str | None) -> tuple[list[tuple[str, str]], list[Token]] | None:
    """Fields of the outer tag, and the tokens of the statement; None if there is no content."""
    if text is None:
        return None
    rest = text[_LEAD.match(text).end() :]
    if not rest:
        return None
    if rest[0] != "<" or not rest[1:2].isalpha():
        return [], list(_sql_tokens(rest))
    tokens = list(_xml_tokens(rest))
    while tokens and tokens[-1] == ("o", ";"):
        tokens.pop()
    first, *attributes = tokens[0][1].split("\x1e")
    if tokens[0][0] != "<" or tokens[-1] != (">", first):
        return [("tokens", _render(tokens))], []
    return [("tag", first), *(("attribute", a) for a in attributes)], tokens[1:-1]


def _fields(outer: list[tuple[str, str]], tokens: list[Token]) -> list[tuple[str, str]]:
    return outer if outer and outer[0][0] == "tokens" else outer + _sql_fields(_fold(tokens))


def fields_of(text: str | None) -> list[tuple[str, str]]:
    """Pairs of field name and normalised value of one text; empty if it has no content."""
    apart = _taken_apart(text)
    return _fields(*apart) if apart else []


def statement_fields(template: str | None, normalised: str | None) -> list[str] | None:
    """Fields of both columns, each once: repeats are numbered. None if the template has no content."""
    apart = _taken_apart(template)
    if not apart:
        return None
    outer, tokens = apart
    mine = _fields(outer, tokens)
    other = _taken_apart(normalised)
    # what is token by token the same has the same fields
    theirs = [] if not other else mine[len(outer) :] if not other[0] and other[1] == tokens and len(mine) > len(outer) else _fields(*other)
    pairs = [f"t\x1c{n}\x1c{v}" for n, v in mine]
    pairs += ["n\x1cnull"] if normalised is None else [f"n\x1c{n}\x1c{v}" for n, v in theirs]
    if len(set(pairs)) == len(pairs):
        return pairs
    seen: Counter[str] = Counter()
    out = []
    for p in pairs:
        seen[p] += 1
        out.append(p if seen[p] == 1 else f"{p}\x1c#{seen[p]}")
    return out


def fingerprint(fields: list[str], bits: int = 128) -> bytes:
    """Sum of the fields' hashes modulo 2^bits: the same for any order."""
    total = sum(xxhash.xxh3_128_intdigest(f) for f in fields)
    return (total & ((1 << bits) - 1)).to_bytes(16, "big")


_ROWS = "id bigint, fp binary, fields array<string>"
_ROWS_ARROW = pa.schema([("id", pa.int64()), ("fp", pa.binary()), ("fields", pa.list_(pa.string()))])


def _read(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids, prints, fields = [], [], []
                for row, template, normalised in zip(*(part.column(c).to_pylist() for c in ("id", "template", "normalised"))):
                    if (mine := statement_fields(template, normalised)) is not None:
                        ids.append(row)
                        prints.append(fingerprint(mine, bits))
                        fields.append(mine)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), pa.array(fields, pa.list_(pa.string()))], schema=_ROWS_ARROW)

    return run


def statement_classes(rows: DataFrame, row_id: Column, template: Column, normalised: Column, bits: int = 128) -> DataFrame:
    """id, keep_id for each row with a statement: keep_id is the smallest id of the rows equal to it."""
    read = (
        rows.select(row_id.cast("bigint").alias("id"), template.alias("template"), normalised.alias("normalised"))
        .where(F.col("id").isNotNull() & (F.col("template") != ""))
        .mapInArrow(_read(bits), _ROWS)
    )
    read = cut(read)
    ids = read.select("fp", "id")
    groups = cut(ids.groupBy("fp").agg(F.min("id").alias("keep_id"), F.max("id").alias("last_id")).where("keep_id < last_id").select("fp", "keep_id"))
    alone = ids.join(groups.select("fp"), "fp", "left_anti").select("id", F.col("id").alias("keep_id"))
    # only groups of two or more are compared, each row with the first of its group
    open_rows = read
    right = alone
    while True:
        hot = heavy(open_rows, "fp")
        # the fields move once: rows meet the smallest id of their group, and then its fields where they lie
        rows = salted(open_rows.where("id IS NOT NULL AND fp IS NOT NULL"), "fp", hot).join(repeated(groups.where("keep_id IS NOT NULL"), "fp", hot), ["fp", "_salt"])
        first = rows.where("id <= keep_id").groupBy("fp", "id").agg(F.collect_set("fields")[0].alias("keep_fields")).drop("id")
        compared = rows.join(repeated(first, "fp", hot), ["fp", "_salt"])
        same = (F.size("fields") == F.size("keep_fields")) & (F.size(F.array_except("fields", "keep_fields")) == 0)
        checked, counts = cut_counted(compared.select("id", "keep_id", "fp", same.alias("same"), F.when(~same, F.col("fields")).alias("fields")), wrong=F.count_if(~F.col("same")))
        right = right.unionByName(checked.where("same").select("id", "keep_id"))
        if not counts["wrong"]:
            return right.distinct()
        # rows that collided are grouped among themselves; each round settles a statement of every fingerprint
        open_rows = checked.where("NOT same").select("id", "fp", "fields")
        groups = cut(open_rows.groupBy("fp").agg(F.min("id").alias("keep_id")))
