"""String functions as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_str(x: Column) -> Column:
    """Null becomes the text None; blanks are collapsed and trimmed."""
    return F.coalesce(F.trim(F.regexp_replace(x.cast("string"), r"\s+", " ")), F.lit("None"))


def norm_bool(x: Column, letters: bool = True) -> Column:
    """true/yes/1 and false/no/0 (with ``letters`` also y and n), else null."""
    t = F.lower(F.trim(x.cast("string")))
    yes, no = ["true", "yes", "1"] + ["y"] * letters, ["false", "no", "0"] + ["n"] * letters
    return F.when(t.isin(yes), True).when(t.isin(no), False)


def strip_fences(x: Column) -> Column:
    """Text without code-fence lines, from the last ``assistant`` header on."""
    inner = F.regexp_replace(x, r"(?m)^```[a-zA-Z]*[ \t]*$\n?", "")
    return F.regexp_replace(F.element_at(F.split(inner, "assistant\n"), -1), r"^\s+|\s+$", "")


def drop_lines(x: Column, prefixes: list[str]) -> Column:
    """Text without the lines that start with one of the prefixes."""

    def keep(line):
        t = F.ltrim(line)
        bad = F.lit(False)
        for p in prefixes:
            bad = bad | t.startswith(p)
        return ~bad

    return F.array_join(F.filter(F.split(x, "\n"), keep), "\n")


def lines(x: Column) -> Column:
    """Non-empty trimmed lines."""
    return F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def csv_list(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), lambda s: F.trim(s)), lambda s: s != "")


def big_number(x: Column, digits: int = 0) -> Column:
    """Human form with K, M, B, T, Q steps of a thousand; halves go to the even digit, null stays null."""
    value, out = x.cast("double"), None
    for i, suffix in reversed(list(enumerate(["", "K", "M", "B", "T", "Q"]))):
        text = F.concat(F.format_string(f"%.{digits}f", F.bround(value / F.lit(1000.0**i), digits)), F.lit(suffix))
        out = text if out is None else F.when(F.abs(value) < 1000.0 ** (i + 1), text).otherwise(out)
    return F.when(value.isNotNull(), out)


def episode_number(x: Column) -> Column:
    """Number after the last underscore, null if there is none."""
    return F.element_at(F.split(x, "_"), -1).try_cast("int")


def frame_number(x: Column) -> Column:
    """frame_000123.jpg gives 123; names of other forms give null."""
    return F.nullif(F.regexp_extract(x, r"^frame_(\d+)\.", 1), F.lit("")).cast("int")


def coerce_status(x: Column, allowed: list[str], default: str) -> Column:
    t = F.upper(F.trim(x))
    return F.when(t.isin(allowed), t).otherwise(F.lit(default))


def two_sentences(x: Column) -> Column:
    """Bullets stripped, blanks collapsed, the first two sentences with a final period."""
    t = F.trim(F.regexp_replace(F.regexp_replace(x, r"(?m)^[ \t]*[-*•]+[ \t]*", ""), r"\s+", " "))
    parts = F.filter(F.transform(F.split(t, r"\."), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(parts) > 0, F.concat(F.array_join(F.slice(parts, 1, 2), ". "), F.lit("."))).otherwise(F.lit(""))


def preview(x: Column, n: int) -> Column:
    return F.left(F.replace(x, F.lit("\n"), F.lit(" ")), F.lit(n))


def safe_name(x: Column) -> Column:
    return F.translate(x, ":/", "__")


def dataset_name(path: Column) -> Column:
    """The folder before ``videos``, else the grandparent folder."""
    before = F.regexp_extract(path, r"/([^/]+)/videos/", 1)
    return F.when(before != "", before).otherwise(F.element_at(F.split(path, "/"), -3))


def row_identifier(uid: Column, chunk: Column, episode: Column, ts: Column) -> Column:
    parts = F.when(chunk.isNotNull() & episode.isNotNull(), F.concat_ws("|", chunk.cast("string"), episode.cast("string"), F.coalesce(ts.cast("string"), F.lit("?"))))
    return F.coalesce(F.nullif(uid.cast("string"), F.lit("")), parts, F.lit("unknown"))


def hashed_uid(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts joined by ``::``."""
    return F.substring(F.sha1(F.concat_ws("::", *[p.cast("string") for p in parts]).cast("binary")), 1, 16)


def strip_text(x: Column) -> Column:
    """Without blanks and line ends at both ends; null becomes empty."""
    return F.coalesce(F.regexp_replace(x.cast("string"), r"^\s+|\s+$", ""), F.lit(""))


def number_bool(x: Column) -> Column:
    """A number other than 0 is true; null stays null."""
    return x.cast("double") != 0


def strip_wrapping(x: Column, prefix: str, suffix: str) -> Column:
    """Without one prefix and one suffix, each only where it stands."""
    head = F.when(F.startswith(x, F.lit(prefix)), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x)
    return F.when(F.endswith(head, F.lit(suffix)), F.substring(head, F.lit(1), F.length(head) - len(suffix))).otherwise(head)


def weight_spec(x: Column) -> Column:
    """``a=1, b=0.5`` as map<string,double>; the last value of a key wins, a part without ``=`` is an error."""

    def put(done, part):
        raw = F.substring_index(part, "=", 1)
        key = F.when(F.contains(part, F.lit("=")), F.trim(raw)).otherwise(F.raise_error(F.concat(F.lit("bad weight: "), part)).cast("string"))
        value = F.trim(F.substring(part, F.length(raw) + 2, F.length(part))).cast("double")
        return F.map_concat(F.map_filter(done, lambda k, v: k != key), F.create_map(key, value))

    return F.aggregate(csv_list(F.coalesce(x, F.lit(""))), F.expr("cast(map() as map<string,double>)"), put)


def int_ranges(x: Column) -> Column:
    """``3, 35:41, 50-48`` as sorted distinct numbers; ranges are inclusive, in either order; else an error.

    Ranges are sorted and cut where one before them ends, so each number is made once, in its place.
    """

    def ends(part):
        good = F.regexp_like(part, F.lit(r"^\d+(\s*[:-]\s*\d+)?$"))
        both = F.array_sort(F.transform(F.split(part, r"\s*[:-]\s*"), lambda e: e.try_cast("long")))
        span = F.struct(F.get(both, F.lit(0)).alias("low"), F.element_at(both, -1).alias("high"))
        return F.when(good, span).otherwise(F.raise_error(F.concat(F.lit("bad number or range: "), part)).cast("struct<low:bigint,high:bigint>"))

    def cut(done, span):
        low = F.greatest(span["low"], done["high"] + 1)
        left = F.when(low <= span["high"], F.array(F.struct(low.alias("low"), span["high"].alias("high")))).otherwise(F.expr(f"cast(array() as {spans})"))
        return F.struct(F.concat(done["spans"], left).alias("spans"), F.greatest(done["high"], span["high"]).alias("high"))

    spans = "array<struct<low:bigint,high:bigint>>"
    none = F.struct(F.expr(f"cast(array() as {spans})").alias("spans"), F.lit(-1).cast("long").alias("high"))
    apart = F.aggregate(F.array_sort(F.transform(csv_list(F.coalesce(x, F.lit(""))), ends)), none, cut)["spans"]
    return F.flatten(F.transform(apart, lambda s: F.sequence(s["low"], s["high"])))


def user_text(x: Column, dropped: list[str], header: Column | None = None) -> Column:
    """Text without the lines of the dropped prefixes, under an optional header."""
    body = strip_text(drop_lines(x, dropped))
    return body if header is None else strip_text(F.concat(header, F.lit("\n\n"), body))
