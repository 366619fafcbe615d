"""Invoices that several shipments share: the shipments that a text names, owners of lines, the split, and the bill lines of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaywise.functions import money
from quaywise.sources.scratch import materialise

from .versions import merged

from .allocation import split_table

#: A bill of lading or container names a shipment from so many characters on.
LEAST = 6


def words_of(text: Column | str) -> Column:
    """Distinct references that a text may print: its words and pairs of neighbouring words, letters and digits only, in capitals."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.regexp_replace(F.upper(F.coalesce(t, F.lit(""))), r"[^A-Z0-9\s]", ""), r"\s+"), lambda w: w != "")

    def with_pairs(w: Column) -> Column:
        most = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, most), F.slice(w, 2, most), lambda a, b: F.concat(a, b)))

    # a lambda's argument is worked out once, an expression wherever it is named
    both = F.element_at(F.transform(F.array(words), with_pairs), 1)
    return F.array_distinct(F.filter(both, lambda w: F.length(w) >= LEAST))


def named_parties(texts: DataFrame, refs: DataFrame) -> DataFrame:
    """Shipments of the same organisation whose reference a text prints: key, shipment_id, refs (sorted).

    ``texts``: org_id, doc_id, text. ``refs``: org_id, shipment_id, ref (normalised). Both sides meet by equal references, so an
    invoice never meets shipments that it doesn't name.
    """
    printed = texts.select("org_id", "doc_id", F.explode(words_of("text")).alias("ref"))
    met = printed.join(refs.filter(F.length("ref") >= LEAST).distinct(), ["org_id", "ref"])
    return met.groupBy("org_id", "doc_id", "shipment_id").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


def line_owners(lines: DataFrame, party_refs: DataFrame) -> DataFrame:
    """``lines`` with ``owner``: the one party that a line names, null if it names none or several.

    ``lines``: doc_id, line, description and more. ``party_refs``: doc_id, party, ref; references of two parties of an invoice name neither.
    """
    own = party_refs.groupBy("doc_id", "ref").agg(F.min("party").alias("party"), F.count_distinct("party").alias("_n")).filter("_n = 1").drop("_n")
    words = lines.select("doc_id", "line", F.explode(words_of("description")).alias("ref"))
    hits = words.join(own, ["doc_id", "ref"]).groupBy("doc_id", "line").agg(F.min("party").alias("owner"), F.count_distinct("party").alias("_n"))
    return lines.join(hits.filter("_n = 1").drop("_n"), ["doc_id", "line"], "left")


def split_shared(lines: DataFrame, parties: DataFrame) -> DataFrame:
    """doc_id, line, party, part (cents): lines with an owner go to it whole; the rest is split as one amount by the parties' weights
    and spread back over its lines, exact both ways.

    ``lines``: doc_id, line, cents, owner. ``parties``: doc_id, party, w (long).
    """
    owned = lines.filter("owner is not null").select("doc_id", "line", F.col("owner").alias("party"), F.col("cents").alias("part"))
    rest = lines.filter("owner is null and cents <> 0").select("doc_id", F.col("line").cast("int").alias("line"), F.col("cents").alias("line_cents"))
    total = rest.groupBy("doc_id").agg(F.sum("line_cents").alias("t"))
    shares = money.split_exactly(parties.join(total, "doc_id"), ["doc_id"], "t", "w", ["party"], "party_cents").select("doc_id", "party", "party_cents")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("party")).cast("int")
    numbered = materialise(shares.withColumn("_nth", place), "shares")
    table = split_table(rest, numbered.select("doc_id", F.col("_nth").alias("party"), "party_cents"), "doc_id")
    named = table.withColumnRenamed("party", "_nth").join(numbered.select("doc_id", "_nth", "party"), ["doc_id", "_nth"])
    return owned.unionByName(named.select("doc_id", F.col("line").cast(owned.schema["line"].dataType).alias("line"), "party", "part"))


def bill_lines(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of the bill of each party: what of an invoice's lines is its own; lines of nothing are left out."""
    return parts.filter("part <> 0").join(lines.select("doc_id", "line", "description"), ["doc_id", "line"]).select("doc_id", "party", "line", "description", (F.col("part") / 100).cast(money.MONEY).alias("amount"))


def split_state(splits: DataFrame, totals: DataFrame, locked: DataFrame) -> DataFrame:
    """Whether a stored split is active (two parties or more), adds up to the printed total, is frozen, and its digest.

    ``splits``: doc_id, party, amount, currency. ``totals``: doc_id, total, currency. ``locked``: party. The digest changes with any
    share, the total or the currency, so a confirmation made for another split doesn't count.
    """
    rows = splits.withColumnRenamed("currency", "_c").join(locked.select("party").distinct().withColumn("_locked", F.lit(1)), "party", "left")
    entry = F.concat_ws(":", "party", F.col("amount").cast("string"), "_c")
    sums = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("amount").cast(money.MONEY).alias("_sum"), F.array_join(F.array_sort(F.collect_list(entry)), "|").alias("_key"), F.max("_locked").alias("_locked"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi")
    )
    one = (F.col("_lo") == F.col("currency")) & (F.col("_hi") == F.col("currency"))
    return sums.join(totals, "doc_id").select(
        "doc_id", (F.col("_n") >= 2).alias("active"), ((F.col("_sum") == F.col("total")) & one).alias("adds_up"), F.col("_locked").isNotNull().alias("frozen"),
        F.sha2(F.concat(F.col("_key"), F.lit("#"), F.col("total").cast("string"), F.col("currency")), 256).alias("digest"),
    )


def sync_splits(stored: DataFrame, fresh: DataFrame, invoices: DataFrame, locked: DataFrame) -> DataFrame:
    """Stored shares of invoices brought up to date with what is detected now: doc_id, party, amount, currency, action.

    ``stored`` and ``fresh``: doc_id, party, amount, currency. ``invoices``: doc_id, total, currency, dismissed, manual, and what the split was made for,
    was_total and was_currency. ``locked``: party (approved shipments). A split with a locked party stays as it is (frozen). Shares go (gone)
    where a person said that the invoice isn't shared, it has no positive total, or fewer than two parties are left; locked parties get no
    new share. A person's own split of two parties or more keeps its amounts, marked recheck if total or currency changed since. Any other
    split becomes the fresh one: shares are kept, changed, added or gone.
    """
    held = locked.select("party").distinct().withColumn("_locked", F.lit(True))
    own = stored.join(held, "party", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.bool_or("_locked"), F.lit(False)).alias("_frozen"))
    able = fresh.join(held, "party", "left_anti")
    parties = able.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_parties"))
    same = F.col("was_total").eqNullSafe(F.col("total")) & F.col("was_currency").eqNullSafe(F.col("currency"))
    rule = (
        F.when(F.coalesce("_frozen", F.lit(False)), "frozen").when(F.col("total").isNull() | (F.col("total") <= 0) | F.coalesce("dismissed", F.lit(False)), "drop")
        .when(F.coalesce("manual", F.lit(False)) & (F.coalesce("_n", F.lit(0)) >= 2), F.when(same, "own").otherwise("recheck"))
        .when(F.coalesce("_parties", F.lit(0)) < 2, "drop").otherwise("fresh")
    )
    rules = invoices.join(own, "doc_id", "left").join(parties, "doc_id", "left").select("doc_id", rule.alias("_rule"))
    columns = ["doc_id", "party", "amount", "currency"]
    mine = stored.select(*columns).join(rules, "doc_id", "left")
    stays = F.col("_rule").isin("frozen", "own", "recheck")
    kept = mine.filter(stays).select(*columns, F.when(F.col("_rule") == "recheck", "recheck").otherwise("kept").alias("action"))
    wanted = able.select(*columns).join(rules.filter("_rule = 'fresh'"), "doc_id", "left_semi")
    return kept.unionByName(merged(mine.filter(~F.coalesce(stays, F.lit(False))).select(*columns), wanted, ["doc_id", "party"], ["amount", "currency"], []))
