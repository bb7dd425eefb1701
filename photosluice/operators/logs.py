"""Log texts of several programs as entries with time, level, component and message.

Every line is reduced to the shape of its head (digits, letters and blanks collapsed). Each
distinct shape is resolved once to the layout it can belong to: one of the given layouts, or, for
programs that none was given for, the first of a few general rules that takes apart an example of
the shape. The resolved shapes are joined back to the lines, which are then taken apart by their
layout's rule only, in one pass. Lines that begin no entry are attached to the entry before them.
:func:`shape_report` counts the lines of each shape, those of unresolved ones too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photosluice.core.storage import settle

SHAPE_CHARS = 32  # of a line's shape: what decides on a layout stands there; rules always see whole lines
RULES_BROADCAST = 100_000  # resolved shapes, at most 10 MB; beyond it they are joined by shuffle
PROGRESS = "@@PROGRESS@@"
# fixed values: names of levels
LEVELS = {
    "DEBUG": ("debug", "trace", "d", "t", "dbg"),
    "INFO": ("info", "notice", "i", "n"),
    "WARNING": ("warning", "warn", "w"),
    "ERROR": ("error", "err", "e"),
    "CRITICAL": ("critical", "crit", "fatal", "c", "f"),
}
SEVERITIES = ("fatal", "fatal", "crit", "err", "warning", "notice", "info", "debug")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


@dataclass(frozen=True)
class Layout:
    """A program's layout.

    ``shape`` is a pattern over line shapes, ``rule`` one over lines. ``time``, ``level``,
    ``component`` and ``message`` are groups of the rule; ``form`` says how the time is written.
    """

    name: str
    shape: str
    rule: str
    time: int
    level: int
    component: int
    message: int
    form: str
    escaped: bool = False
    timeless: bool = False


LAYOUTS = (
    Layout("comma_ms", r"^9-9-9 9:9:9,9 a ", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{1,6}) +([A-Za-z]+) +(\S+) [—–-] (.*)$", 1, 2, 3, 4, "iso"),
    Layout("offset_brackets", r"^9-9-9a9:9:9[.,]?9?[+-]9:9 \[a\] ", r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?:[+-]\d\d:?\d\d|Z)) \[([A-Za-z]+)\] (.+?): (.*)$", 1, 2, 3, 4, "iso"),
    Layout("utc_brackets", r"^9-9-9a9:9:9[.,]?9?a? \[a\] ", r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d{1,9})?Z?) \[([A-Za-z]+)\] (.+?): (.*)$", 1, 2, 3, 4, "iso"),
    Layout("key_value", r"^a=9-9-9a9:9:9", r'^ts=(\S+) level=([A-Za-z]+) component=("(?:[^"\\]|\\.)*"|\S+) msg="((?:[^"\\]|\\.)*)"\s*$', 1, 2, 3, 4, "iso", True),
    Layout("letter_date", r"^a9 9:9:9\.9 9 ", r"^[A-Z](\d{8} \d\d:\d\d:\d\d\.\d{1,6}) +\d+ ([^\s:\]]+):\d+\] (.*)$", 1, 0, 2, 3, "compact"),
    Layout("epoch_brackets", r"^\[9\.9\] a/", r"^\[(\d+\.\d{1,6})\] ([A-Z])/(.+?)\(\d+\): (.*)$", 1, 2, 3, 4, "seconds"),
    Layout("dotted_bars", r"^9\.9\.9 9:9:9\.?9? \| a ", r"^(\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d(?:\.\d{1,6})?) \| ([A-Za-z]+) *\| (.*?) +?\| (.*)$", 1, 2, 3, 4, "dotted"),
    Layout("slashes", r"^9/9/9 9:9:9 \[a\] ", r"^(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[([A-Za-z]+)\] (.+?)#\d+: (.*)$", 1, 2, 3, 4, "slashed"),
    Layout("calendar", r"^a a 9 9:9:9 9 ", r"^([A-Z][a-z]{2} [A-Z][a-z]{2} [ \d]?\d \d\d:\d\d:\d\d \d{4}) (\S+) ([A-Za-z]+): (.*)$", 1, 3, 2, 4, "calendar"),
    Layout("epoch_ms", r"^9 a \(", r"^(\d{12,14}) ([A-Za-z]+) \(([^)]*)\) (.*)$", 1, 2, 3, 4, "millis"),
)
_TIME = r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d{1,9})?(?:Z| ?[+-]\d\d:?\d\d)?)"
_LEVEL = r"[\[(<]?(?i:(trace|debug|dbg|info|notice|warn|warning|err|error|crit|critical|fatal))[\])>]?"
_COMPONENT = r"[\[(]?([^\s:\[\]()|]+)(?:\[\d+\])?[\])]?"
# general rules, tried in this order on an example of every shape that no layout takes; group 0 means "none"
GENERAL = (
    Layout("syslog", "", r"^<(\d{1,3})>\d{1,2} " + _TIME + r" \S+ (\S+) \S+ \S+ (?:-|\[.*?\])(?: (.*))?$", 2, 1, 3, 4, "iso"),
    Layout("time_level", "", r"^[\[(]?" + _TIME + r"[\])]?[ |,-]+" + _LEVEL + r"[ |:-]+" + _COMPONENT + r" ?(?::|\||-|—)+ (.*)$", 1, 2, 3, 4, "iso"),
    Layout("time_component", "", r"^[\[(]?" + _TIME + r"[\])]?[ |,-]+" + _COMPONENT + r"[ |:-]+" + _LEVEL + r" ?(?::|\||-|—)+ (.*)$", 1, 3, 2, 4, "iso"),
    Layout("letter_day", "", r"^([DIWEF])\d{4} \d\d:\d\d:\d\d\.\d{1,6} +\d+ ([^\s:\]]+):\d+\] (.*)$", 0, 1, 2, 3, "none", timeless=True),
    Layout("level_only", "", r"^" + _LEVEL + r":? +" + _COMPONENT + r": (.*)$", 0, 1, 2, 3, "none", timeless=True),
)
JSON_LAYOUT = "json"
# fixed values: keys of entries written as JSON
JSON_KEYS = {
    "time": ("timestamp", "time", "@t", "@timestamp", "ts"),
    "level": ("level", "lvl", "severity"),
    "component": ("component", "logger", "source", "name"),
    "message": ("message", "msg", "text"),
}


def shape_of(line: str | Column) -> Column:
    """The head of a line's shape: runs of digits as ``9``, of letters as ``a``, of blanks as one blank."""
    c = F.col(line) if isinstance(line, str) else line
    for pattern, mark in ((r"\p{Nd}+", "9"), (r"[\p{L}_]+", "a"), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, mark)
    return F.left(c, F.lit(SHAPE_CHARS))


def resolved_shapes(lines: DataFrame, layouts: Sequence[Layout] = LAYOUTS, general: Sequence[Layout] = ()) -> DataFrame:
    """(``shape``, ``layout``, ``second``) of every distinct shape that some layout can have.

    ``second`` is the ``general`` rule that takes an example of the shape, for lines that the layout's rule doesn't fit.
    """
    return _resolved(lines, layouts, general).where("layout is not null").select("shape", "layout", "second")


def _resolved(lines: DataFrame, layouts: Sequence[Layout], general: Sequence[Layout]) -> DataFrame:
    rule = F.when(F.col("shape").startswith("{"), JSON_LAYOUT)
    for layout in layouts:
        rule = rule.when(F.col("shape").rlike(layout.shape), layout.name)
    second = F.lit(None).cast("string")
    for layout in reversed(general):
        second = F.when(F.col("example").rlike(layout.rule), layout.name).otherwise(second)
    example = F.min("line") if general else F.lit("")
    found = lines.groupBy("shape").agg(example.alias("example"), F.count("*").alias("lines")).withColumns({"layout": rule, "second": second})
    return found.withColumn("layout", F.coalesce("layout", "second"))


def shape_report(logs: DataFrame, text_col: str, *keys: str, layouts: Sequence[Layout] = LAYOUTS, general: Sequence[Layout] = GENERAL) -> DataFrame:
    """(``layout``, ``shapes``, ``lines``): how many line shapes and lines each layout takes; null for those that none does.

    Further lines of entries have shapes too, and mostly no layout.
    """
    lines = log_lines(logs, text_col, *keys).where(~F.col("line").startswith(PROGRESS) & F.col("line").rlike(r"\S"))
    found = _resolved(lines.withColumn("shape", shape_of("line")), layouts, general)
    return found.groupBy("layout").agg(F.count("*").alias("shapes"), F.sum("lines").alias("lines"))


def level_name(c: Column) -> Column:
    """DEBUG, INFO, WARNING, ERROR or CRITICAL; null for anything else."""
    out = None
    for name, spellings in LEVELS.items():
        test = F.lower(c).isin(*spellings)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def _iso_micros(c: Column) -> Column:
    zoned = F.when(c.rlike(r"(Z|[+-]\d\d:?\d\d)$"), c).otherwise(F.concat(c, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(zoned, r"([+-]\d\d)(\d\d)$", "$1:$2")))


def micros(c: Column, form: str) -> Column:
    """Microseconds since 1970 UTC of a time written in ``form``; null if there is no such time."""
    if form == "iso":
        return _iso_micros(F.regexp_replace(F.regexp_replace(c, ",", "."), r"^(\S{10}) ", "$1T"))
    if form == "compact":
        return _iso_micros(F.regexp_replace(c, r"^(\d{4})(\d\d)(\d\d) ", "$1-$2-$3T"))
    if form == "dotted":
        return _iso_micros(F.regexp_replace(c, r"^(\d\d)\.(\d\d)\.(\d{4}) ", "$3-$2-$1T"))
    if form == "slashed":
        return _iso_micros(F.regexp_replace(c, r"^(\d{4})/(\d\d)/(\d\d) ", "$1-$2-$3T"))
    if form == "calendar":
        month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(c, 5, 3))
        day = F.trim(F.substring(c, 9, 2))
        iso = F.format_string("%s-%02d-%sT%s", F.right(c, F.lit(4)), month, F.lpad(day, 2, "0"), F.regexp_extract(c, r"(\d\d:\d\d:\d\d)", 1))
        return F.when(month > 0, _iso_micros(iso))
    if form == "millis":
        return c.cast("long") * 1000
    whole = F.split_part(c, F.lit("."), F.lit(1)).cast("long")
    return whole * 1_000_000 + F.rpad(F.split_part(c, F.lit("."), F.lit(2)), 6, "0").cast("long")


def _unescaped(c: Column) -> Column:
    """Text with backslash escapes resolved."""
    return F.coalesce(F.from_json(F.concat(F.lit('{"x":"'), c, F.lit('"}')), "x string")["x"], c)


def _fields(line: Column, layouts: Sequence[Layout]) -> Column:
    """Time, level, component and message of a line by its layout's rule, and an empty text; a single text where it doesn't fit."""
    out = F.when(F.lit(False), F.array(F.lit("")))
    for layout in layouts:
        # one pass of the rule; lines that hold the mark themselves are searched group by group
        groups = [layout.time, layout.level, layout.component, layout.message]
        fields = F.split(F.regexp_replace(line, layout.rule, _MARK.join(f"${g}" if g else "" for g in groups) + _MARK), _MARK)
        slow = F.array(*[F.regexp_extract(line, layout.rule, g) if g else F.lit("") for g in groups], F.lit(""))
        slow = F.when(line.rlike(layout.rule), slow)
        out = out.when(F.col("layout") == layout.name, F.when(line.contains(_MARK), slow).otherwise(fields))
    return out


_MARK = "\u0001"


def _head(line: Column, layouts: Sequence[Layout]) -> Column:
    """Struct (``ts_us``, ``level``, ``component``, ``message``) of a line from its ``fields``, null where it doesn't fit."""
    j = F.from_json(line, "map<string,string>")
    pick = lambda what: F.coalesce(*[j[k] for k in JSON_KEYS[what]])
    out = F.when(
        F.col("layout") == JSON_LAYOUT,
        F.struct(
            _iso_micros(pick("time")).alias("ts_us"), level_name(pick("level")).alias("level"),
            pick("component").alias("component"), pick("message").alias("message"), F.lit(False).alias("timeless"),
        ),
    )
    at = lambda k: F.get("fields", k)
    for layout in layouts:
        level, component, message = (at(k) for k in (1, 2, 3))
        if not layout.level:
            level = F.substring(line, 1, 1)
        if layout.name == "syslog":
            level = F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), F.expr("try_cast(get(fields, 1) as int) % 8 + 1"))
        if layout.escaped:
            component = F.when(component.startswith('"'), _unescaped(component.substr(F.lit(2), F.length(component) - 2))).otherwise(component)
            message = _unescaped(message)
        time = F.lit(None).cast("long") if layout.timeless else micros(at(0), layout.form)
        out = out.when(
            (F.col("layout") == layout.name) & (F.size("fields") == 5),
            F.struct(time.alias("ts_us"), level_name(level).alias("level"), component.alias("component"), message.alias("message"), F.lit(layout.timeless).alias("timeless")),
        )
    return out


def log_lines(logs: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """(``keys``, ``line_no``, ``line``): lines from 1, without carriage returns and colour codes; repeated rows once."""
    rows = logs.where(F.col(text_col).isNotNull()).select(*keys, F.col(text_col).alias("_text")).distinct()
    bare = F.regexp_replace(F.regexp_replace("_line", r"\r$", ""), "\u001b\\[[0-9;?]*[A-Za-z]", "")
    return rows.select(*keys, F.posexplode(F.split("_text", "\n")).alias("_at", "_line")).select(
        *keys, (F.col("_at") + 1).cast("long").alias("line_no"), bare.alias("line")
    )


def log_entries(
    logs: DataFrame, text_col: str, *keys: str, with_message: bool = True, layouts: Sequence[Layout] = LAYOUTS, general: Sequence[Layout] = ()
) -> DataFrame:
    """The entries of log texts.

    Columns: ``keys``, ``first_line``, ``last_line``, ``ts_us``, ``level``, ``component``,
    ``message_chars`` and ``message``. An entry begins with a line in one of the layouts and ends
    at its last non-blank line before the next; further lines are added to the message with a line
    feed each. Lines before the first entry and progress lines belong to none. Null and empty
    texts have no entries; rows are told apart by ``keys``, and repeated ones count once.

    ``layouts`` are the programs' layouts; with ``general`` (:data:`GENERAL`), shapes that none of
    them takes are resolved by general rules, of which some know no time: ``ts_us`` is null then.
    """
    lines = log_lines(logs, text_col, *keys).where(~F.col("line").startswith(PROGRESS))
    shaped = settle(lines.withColumn("shape", shape_of("line")), "lines")
    rules = settle(resolved_shapes(shaped, layouts, general), "shapes")
    if rules.count() <= RULES_BROADCAST:
        rules = F.broadcast(rules)
    known = [*layouts, *general]
    lined = shaped.join(rules, "shape", "left").select(*keys, "line_no", "line", "layout", "second", _fields(F.col("line"), known).alias("fields"))
    if general:
        fits = (F.col("layout") == JSON_LAYOUT) | (F.size("fields") == 5)
        lined = lined.withColumn("layout", F.when(F.coalesce(fits, F.lit(False)), F.col("layout")).otherwise(F.col("second")))
        lined = lined.withColumn("fields", F.when(F.size("fields") == 5, F.col("fields")).otherwise(_fields(F.col("line"), general)))
    lined = lined.select(*keys, "line_no", "line", _head(F.col("line"), known).alias("h"))
    begins = (F.col("h.ts_us").isNotNull() | F.col("h.timeless")) & F.col("h.level").isNotNull() & F.col("h.component").isNotNull() & F.col("h.message").isNotNull()
    lined = lined.withColumn("h", F.when(begins, F.col("h")))
    upto = Window.partitionBy(*keys).orderBy("line_no")
    owned = lined.withColumn("first_line", F.last(F.when(F.col("h").isNotNull(), F.col("line_no")), ignorenulls=True).over(upto)).where("first_line is not null")
    full = F.when(F.col("line").rlike(r"\S"), F.col("line_no"))
    entry = Window.partitionBy(*keys, "first_line").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = owned.withColumn("last_line", F.greatest("first_line", F.max(full).over(entry))).where("line_no <= last_line")
    text = F.when(F.col("h").isNotNull(), F.col("h.message")).otherwise(F.col("line"))
    aggregates = [
        F.max("last_line").alias("last_line"),
        *[F.max(f"h.{c}").alias(c) for c in ("ts_us", "level", "component")],
        (F.sum(F.length(text)) + F.count("*") - 1).alias("message_chars"),
    ]
    if with_message:
        aggregates.append(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x["t"]), "\n").alias("message"))
    return kept.groupBy(*keys, "first_line").agg(*aggregates)
