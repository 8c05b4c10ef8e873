"""JSON, YAML and conversation functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def clean(x: Column) -> Column:
    """JSON-like text made parseable: line ends, control characters, quotes, commas."""
    t = F.regexp_replace(x, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    t = F.translate(t, "“”„‘’", "\"\"\"''")
    t = F.regexp_replace(t, r",(\s*,)+", ",")
    return F.regexp_replace(F.regexp_replace(t, r",\s*([}\]])", "$1"), r"^\s+|\s+$", "")


def outer_object(x: Column) -> Column:
    """From the first ``{`` to the last ``}``, empty if there is none."""
    return F.regexp_extract(x, r"(?s)\{.*\}", 0)


def field(x: Column, key: str) -> Column:
    """A field of the outer object if that parses, else what stands after the quoted key.

    A quoted value may hold quotes and line ends: it goes on to the quote before the next
    quoted key, the closing brace, a nested object on a new line or the end. Blanks of such a
    value are collapsed. Null if the key is absent or its value is empty.
    """
    whole, empty = F.from_json(outer_object(x), "map<string,string>", {"mode": "PERMISSIVE"}), F.lit("")
    name = re.escape(key)
    quoted = F.regexp_extract(x, rf'(?s)"{name}"\s*:\s*"(.*?)(?:"\s*,\s*"[^"\n]+"\s*:|"\s*,?\s*\}}|\n\s*\{{\s*"[^"\n]+"\s*:|"?\s*$)', 1)
    bare = F.regexp_extract(x, rf'"{name}"\s*:\s*([^,}}\s"]+)', 1)
    salvaged = F.coalesce(F.nullif(F.trim(F.regexp_replace(quoted, r"\s+", " ")), empty), F.nullif(bare, empty))
    return F.when(whole.isNotNull(), whole[key]).otherwise(salvaged)


def flat_yaml(x: Column) -> Column:
    """Map of the ``key: value`` lines; other lines are dropped, the last of equal keys wins.

    Lines are sorted by key once, so that a line is the last of its key if the next has
    another; the cost grows with the lines, but for the sort.
    """
    rows = F.filter(F.split(x, "\n"), lambda s: s.rlike(r"^\s*[^:#\s][^:]*:"))
    entries = F.transform(rows, lambda s, i: F.struct(F.trim(F.regexp_extract(s, r"^([^:]*):", 1)).alias("key"), i.alias("i"), F.trim(F.regexp_extract(s, r"^[^:]*:(.*)$", 1)).alias("value")))
    in_order = F.array_sort(entries)
    paired = F.zip_with(in_order, F.slice(in_order, F.lit(2), F.greatest(F.size(rows), F.lit(1))), lambda e, n: F.struct(e.alias("e"), (n.isNull() | (n["key"] != e["key"])).alias("last")))
    last = F.transform(F.filter(paired, lambda p: p["last"]), lambda p: F.struct(p["e"]["i"].alias("i"), p["e"]["key"].alias("key"), p["e"]["value"].alias("value")))
    return F.map_from_entries(F.transform(F.array_sort(last), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def yaml_paths(text: str | None, sep: str = "/") -> dict[str, str] | None:
    """Path to value of a block-style YAML text: nested maps, lists, comments, quotes, block texts.

    One pass over the lines with a stack of (indent, path, next list number). List items are
    numbered from 0 in the path. A code fence around the text is cut off; lines that are
    neither ``key: value``, an item nor part of a block text are dropped. The last of equal
    paths wins; a key without anything below has the value ``""``. Anchors, tags and flow
    collections are plain text.
    """
    if text is None:
        return None
    found: dict[str, str] = {}
    stack: list[list] = [[-1, "", 0]]  # indent of the line, its path, number of its next item
    block = None  # (indent of its key, path, style, lines)

    def join(path, name):
        return f"{path}{sep}{name}" if path else name

    def scalar(v: str) -> str:
        v = v.strip()
        if v[:1] in "'\"" and v:
            end = v.find(v[0], 1)
            while v[0] == "'" and end >= 0 and v[end : end + 2] == "''":
                end = v.find("'", end + 2)
            if end > 0:
                return v[1:end].replace("''", "'") if v[0] == "'" else v[1:end]
        at = 0 if v.startswith("#") else v.find(" #")
        return v if at < 0 else v[:at].rstrip()

    def close():
        _, path, style, lines = block
        least = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
        found[path] = ("\n" if style == "|" else " ").join(x[least:].rstrip() for x in lines).strip()

    for line in text.split("\n"):
        line = line.rstrip("\r")
        indent, body = len(line) - len(line.lstrip(" ")), line.strip()
        if block is not None:
            if not body or indent > block[0]:
                block[3].append(line)
                continue
            close()
            block = None
        if not body or body.startswith(("#", "```")) or body in ("---", "..."):
            continue
        while True:
            item = body == "-" or body.startswith("- ")
            while stack[-1][0] > indent or (stack[-1][0] == indent and not (item and not stack[-1][3:])):
                stack.pop()
            if not item:
                break
            parent = stack[-1]
            path = join(parent[1], str(parent[2]))
            parent[2] += 1
            found.pop(parent[1], None)
            stack.append([indent, path, 0, True])
            rest = body[1:].lstrip()
            indent, body = indent + len(body) - len(rest), rest
            if not body or not _KEY.match(body) and not body.startswith("- "):
                found[path] = scalar(body)
                body = ""
                break
        if not body:
            continue
        m = _KEY.match(body)
        if m is None:
            continue
        path, value = join(stack[-1][1], scalar(m[1])), (m[2] or "").strip()
        found.pop(stack[-1][1], None)
        stack.append([indent, path, 0])
        if value[:1] in ("|", ">") and len(value) <= 2:
            block = (indent, path, value[0], [])
        else:
            found.pop(path, None)
            found[path] = scalar(value)
    if block is not None:
        close()
    return found


#: A key in quotes or bare, a colon, and the rest behind a blank.
_KEY = re.compile(r"""("[^"]*"|'[^']*'|[^\s:#'"\[{-][^:]*|-[^\s:][^:]*)\s*:(?:\s+(.*))?$""")


def nested_yaml(x: Column) -> Column:
    """Map of path to value of a nested YAML text (``yaml_paths``), parsed in Arrow batches."""

    def run(texts):
        return texts.map(yaml_paths)

    import pandas as pd

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "map<string,string>")(x)


def dump_yaml(fields: dict[str, Column]) -> Column:
    """``key: value`` lines in the given order."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()])


def replace_assistant(turns: Column, text: Column) -> Column:
    """Turns with the assistant's texts replaced, or one appended if it never spoke."""
    new = F.transform(turns, lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.when(t["role"] == "assistant", text).otherwise(t["text"]).alias("text")))
    added = F.array(F.struct((F.array_max(F.transform(turns, lambda t: t["turn"])) + 1).alias("turn"), F.lit("assistant").alias("role"), text.alias("text")))
    return F.when(F.exists(turns, lambda t: t["role"] == "assistant"), new).otherwise(F.concat(new, added))


def ordered(have: Column, meta: Column, fallback: list[str]) -> Column:
    """Names in the order of ``meta`` (else of the fallback), the others by alphabet."""
    want = F.coalesce(meta, F.array(*[F.lit(x) for x in fallback]))
    return F.concat(F.filter(want, lambda x: F.array_contains(have, x)), F.array_sort(F.array_except(have, want)))


def flatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Struct fields as columns whose names join the path."""

    def walk(schema: StructType, path: list[str]):
        for f in schema.fields:
            at = [*path, f.name]
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, at)
            else:
                yield F.col(".".join(f"`{p}`" for p in at)).alias(sep.join(at))

    return df.select(*walk(df.schema, []))


def unflatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Inverse of ``flatten``: columns ``a/b`` become fields of a struct ``a``."""
    tree: dict = {}
    for c in df.columns:
        at, *rest = c.split(sep)
        node = tree.setdefault(at, {} if rest else c)
        for i, p in enumerate(rest):
            node = node.setdefault(p, c if i == len(rest) - 1 else {})

    def build(name, node):
        return F.col(f"`{node}`").alias(name) if isinstance(node, str) else F.struct(*[build(k, v) for k, v in node.items()]).alias(name)

    return df.select(*[build(k, v) for k, v in tree.items()])


def missing_keys(parsed: Column, required: list[str]) -> Column:
    """Required keys that a parsed map lacks, in the given order; all of them for a null map."""
    have = F.coalesce(F.map_keys(parsed), F.expr("cast(array() as array<string>)"))
    return F.filter(F.array(*[F.lit(k) for k in required]), lambda k: ~F.array_contains(have, k))


def required_text(x: Column, what: str) -> Column:
    """The text itself; null, empty or blank is an error that names what is empty."""
    blank = F.coalesce(F.trim(x) == "", F.lit(True))
    return F.when(blank, F.raise_error(F.lit(f"{what} is empty")).cast("string")).otherwise(x)
