"""Mixing sources to target weights, by pivotal dependent rounding.

A mix is as large as its scarcest source allows. Each document of a source gets the same expected
number of copies; its whole part is certain, its fraction a probability. Fractions are rounded in
pairs: token mass moves at random from one document to the other, keeping both expectations and
the tokens of the pair, until one of them is whole. Each task rounds its share of a source down to
one open document; these are combined through a tree of ever fewer shares, and the last one of a
source is rounded by chance. Hence each source misses its tokens by less than one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photosluice.core.storage import settle
from photosluice.llm.tokens import TOKENIZER, token_counts

ROWS_PER_SHARE = 20_000
FAN_IN = 256
_WHOLE = 1e-9


def plain_source(source: str | Column) -> Column:
    """Plain spelling of a source: lower case, trimmed, separators and blanks as one ``_``."""
    c = F.col(source) if isinstance(source, str) else source
    plain = F.regexp_replace(F.lower(c), r"[\s\p{Z}\-_./]+", "_")
    plain = F.regexp_replace(plain, "^_+|_+$", "")
    return F.when(plain != "", plain)


def pivot(fractions: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round ``fractions`` in [0, 1) pair by pair; returns 0/1 and the position left open (or -1).

    The token mass ``sizes @ fractions`` and every expectation are kept. The open position keeps
    its fraction in the returned array.
    """
    out = fractions.astype(np.float64).tolist()
    w = sizes.tolist()
    chance = rng.random(len(out)).tolist()
    held = -1
    for i in range(len(out)):
        p = out[i]
        if p <= _WHOLE or p >= 1 - _WHOLE:
            out[i] = float(round(p))
            continue
        if held < 0:
            held = i
            continue
        q = out[held]
        # tokens moved to i (up) or to held (down) until either is whole
        up = min((1 - p) * w[i], q * w[held])
        down = min(p * w[i], (1 - q) * w[held])
        move = up if chance[i] * (up + down) < down else -down
        p, q = p + move / w[i], q - move / w[held]
        p_done, q_done = p <= _WHOLE or p >= 1 - _WHOLE, q <= _WHOLE or q >= 1 - _WHOLE
        out[i], out[held] = (float(round(p)) if p_done else p), (float(round(q)) if q_done else q)
        held = -1 if p_done and q_done else (held if p_done else i)
    return np.asarray(out), held


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokenizer: str = TOKENIZER,
    seed: int = 17,
    rows_per_share: int = ROWS_PER_SHARE,
) -> DataFrame:
    """(``mix_id``, ``source``, ``doc_id``, ``tokens``, ``copies``): the documents of every mix, ``copies`` >= 1.

    ``targets`` has (``mix_id``, ``source``, ``target_share``, ``max_repeats``). Sources are
    compared in plain spelling; documents of unknown or no source are in no mix. A mix takes as
    many tokens as it can without repeating any document more than ``max_repeats`` times: its
    scarcest source gives ``max_repeats`` copies of everything. A source without documents or with a
    share of 0 is left out and the shares of the others scaled up. Null, empty or repeated rows: texts without
    tokens are left out, a document delivered twice counts once, rows without id are left out.
    The same seed gives the same result. Empty tables give no rows.
    """
    clean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), plain_source(source_col).alias("source")).where(
        F.col("doc_id").isNotNull() & F.col("source").isNotNull() & (F.length("text") > 0)
    )
    counted = token_counts(clean, "doc_id", "text", tokenizer).where("tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    named = clean.groupBy("doc_id").agg(F.min("source").alias("source"))
    sized = settle(counted.join(named, "doc_id"), "sized")
    supply = sized.groupBy("source").agg(F.sum("tokens").alias("supply"), F.count("*").alias("n"))
    goal = targets.where("target_share > 0 and max_repeats > 0").select("mix_id", plain_source("source").alias("source"), "target_share", "max_repeats")
    goal = goal.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    plan = goal.join(supply, "source")
    whole = plan.groupBy("mix_id").agg(
        F.min(F.col("max_repeats") * F.col("supply") / F.col("target_share")).alias("total")
    )
    plan = plan.join(whole, "mix_id").select(
        "mix_id", "source",
        F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("total") / F.col("supply")).alias("rate"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_share)).alias("shares"),
    )
    each = sized.join(plan, "source").select(
        "mix_id", "source", "doc_id", "tokens", F.floor(F.col("rate") + _WHOLE).cast("int").alias("sure"), "rate", "shares"
    ).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("sure")))
    certain = each.where(f"p <= {_WHOLE}").select("mix_id", "source", "doc_id", "tokens", F.col("sure").alias("copies"))
    live = each.where(f"p > {_WHOLE}").withColumn("share", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shares")))
    live = live.select("mix_id", "source", "share", "doc_id", "tokens", "sure", "p")
    schema = f"mix_id string, source string, share long, doc_id {docs.schema[id_col].dataType.simpleString()}, tokens long, sure int, p double"
    parts, level = [certain], 0
    while True:
        done = settle(live.groupBy("mix_id", "source", "share").applyInArrow(_round_share(seed, level), schema), "rounded")
        open_one = (F.col("p") > 0) & (F.col("p") < 1)
        parts.append(done.where(~open_one).select("mix_id", "source", "doc_id", "tokens", (F.col("sure") + F.col("p").cast("int")).alias("copies")))
        left = done.where(open_one)
        if (left.agg(F.max("share").alias("m")).first()["m"] or 0) == 0:
            break
        live, level = left.withColumn("share", F.floor(F.col("share") / FAN_IN)), level + 1
    # the last open document of a source: by chance
    chance = F.pmod(F.xxhash64("mix_id", "source", "doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    parts.append(left.select("mix_id", "source", "doc_id", "tokens", (F.col("sure") + (chance < F.col("p")).cast("int")).alias("copies")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("copies > 0")


def _round_share(seed: int, level: int):
    """Function that rounds one share of a source down to one open document, for ``applyInArrow``."""

    def round_share(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        name = f"{seed}/{level}/{table['mix_id'][0]}/{table['source'][0]}/{table['share'][0]}"
        rng = np.random.default_rng(list(name.encode()))
        # large documents first, so that the one left open is likely to be small
        order = np.lexsort((rng.random(len(table)), -table.column("tokens").to_numpy()))
        p, _ = pivot(table.column("p").to_numpy()[order], table.column("tokens").to_numpy()[order].astype(np.float64), rng)
        back = np.empty(len(p))
        back[order] = p
        return table.set_column(table.column_names.index("p"), "p", pa.array(back))

    return round_share


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(``mix_id``, ``source``, ``documents``, ``copies``, ``tokens``, ``share``, ``target_share``): shares reached."""
    by = mixed.groupBy("mix_id", "source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens")
    )
    total = by.groupBy("mix_id").agg(F.sum("tokens").alias("total"))
    goal = targets.select("mix_id", plain_source("source").alias("source"), "target_share").groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return goal.join(by, ["mix_id", "source"], "left").join(total, "mix_id", "left").select(
        "mix_id", "source", zero("documents"), zero("copies"), zero("tokens"),
        F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 6).alias("share"), "target_share",
    )


def mix_faults(mixed: DataFrame, docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(``mix_id``, ``source``, ``too_often``, ``foreign``, ``missed``): what must be nothing in every mix.

    Documents taken more than ``max_repeats`` times, documents that the source doesn't have, and
    whether the source misses its share by more tokens than its largest document has.
    """
    goal = targets.where("target_share > 0 and max_repeats > 0").select("mix_id", plain_source("source").alias("source"), "target_share", "max_repeats")
    goal = goal.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    some = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0))
    has = some.select(F.col(id_col).alias("doc_id"), plain_source(source_col).alias("source")).distinct().withColumn("has", F.lit(True))
    goal = goal.join(has.select("source").distinct(), "source", "left_semi")
    rows = mixed.join(goal, ["mix_id", "source"]).join(has, ["doc_id", "source"], "left")
    by = rows.groupBy("mix_id", "source").agg(
        F.sum((F.col("copies") > F.col("max_repeats")).cast("long")).alias("too_often"),
        F.sum(F.col("has").isNull().cast("long")).alias("foreign"),
        F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("tokens").alias("largest"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    by = goal.join(by, ["mix_id", "source"], "left").select("mix_id", "source", "target_share", *map(zero, ("too_often", "foreign", "tokens", "largest")))
    total = by.groupBy("mix_id").agg(F.sum("tokens").alias("total"), F.sum("target_share").alias("shares"), F.sum("largest").alias("slack"))
    off = F.abs(F.col("tokens") - F.col("total") * F.col("target_share") / F.col("shares"))
    return by.join(total, "mix_id").select("mix_id", "source", "too_often", "foreign", (off > F.col("slack")).alias("missed"))
