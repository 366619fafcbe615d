"""Document text: kind, titles, page boundaries, sheet cells, safe cells for spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import _col, norm_ref

#: What titles (in the first four lines) and bodies of each kind of document say.
TITLES = {
    "commercial_invoice": ["commercial invoice"],
    "bill_of_lading": ["bill of lading"],
    "freight_invoice": ["freight invoice", "freight (?:&|and) logistics", "freight charges"],
    "credit_note": ["credit note", "credit memo", "credit advice"],
    "customs_entry": ["entry summary", "cbp form 7501", "customs (?:import )?declaration", "import declaration", "customs entry"],
    "arrival_notice": ["arrival notice", "notice of arrival", "delivery order", "cargo arrival"],
}
BODIES = {
    "commercial_invoice": ["commercial invoice", "unit price", "qty", "buyer", "fob", "purchase order"],
    "bill_of_lading": ["shipped on board", "port of loading", "port of discharge", "notify party", "seal no", "consignee", "vessel"],
    "freight_invoice": ["ocean freight", "terminal handling", "thc", "drayage", "customs clearance", "chassis", "isf filing", "documentation fee", "amount due", "total due", "remit"],
    "credit_note": ["credit note", "credit memo", "original invoice", "credited", "total credit", "credit amount", "amount credited", "against invoice", "refund"],
    "customs_entry": ["entry summary", "entry type", "importer of record", "entered value", "htsus", "hts no", "country of origin", "port code", "summary date", "surety", "customs and border protection", "declaration no", "customs value"],
    "arrival_notice": ["arrival notice", "last free day", "free time", "free days", "estimated time of arrival", "available for pick", "pick up no", "pickup no", "delivery order", "freight release", "customs release", "before release"],
}


def classify(x: Column | str) -> Column:
    """struct(label, confidence): five points for a title, one for each body keyword.

    A credit note's title outweighs the invoices'. Where the first lines say invoice, the title points of bills of lading, entries
    and notices are taken back. Under three points it is 'other'.
    """
    low = F.lower(F.coalesce(_col(x), F.lit("")))
    head = F.array_join(F.slice(F.split(low, r"\r?\n"), 1, 4), "\n")
    credit = head.rlike("|".join(TITLES["credit_note"]))
    scores = []
    for label, titles in TITLES.items():
        titled = head.rlike("|".join(titles))
        if label in ("commercial_invoice", "freight_invoice"):
            titled = titled & ~credit
        words = sum((low.contains(w).cast("int") for w in BODIES[label]), F.lit(0))
        score = F.when(titled, 5).otherwise(0) + words
        if label == "bill_of_lading":
            score = score - F.when(head.contains("invoice") & (score >= 5), 5).otherwise(0)
        elif label in ("customs_entry", "arrival_notice"):
            score = score - F.when(head.contains("invoice") & titled, 5).otherwise(0)
        scores.append(F.struct(score.alias("n"), F.lit(-len(scores)).alias("order"), F.lit(label).alias("label")))
    ranked = F.sort_array(F.array(*scores), asc=False)
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    sure = F.least(F.lit(0.99), F.lit(0.5) + (top["n"] - second["n"]) / (2 * top["n"]))
    clear = top["n"] >= 3
    return F.struct(F.when(clear, top["label"]).otherwise("other").alias("label"), F.when(clear, F.round(sure, 2)).otherwise(0.4).alias("confidence"))


def looks_like_statement(x: Column | str) -> Column:
    """Titled as a statement in its first eight lines (the title line naming no invoice) and speaking of balances."""
    text = F.coalesce(_col(x), F.lit(""))
    lines = F.slice(F.filter(F.transform(F.split(text, r"\r?\n"), lambda s: F.trim(s)), lambda s: s != ""), 1, 8)
    title = r"(?i)\b(statement of account|account statement|statement of accounts|vendor statement|supplier statement|customer statement|statement)\b"
    first = F.try_element_at(F.filter(lines, lambda s: s.rlike(title)), F.lit(1))
    invoice = first.rlike(r"(?i)\b(invoice|credit note|credit memo|bill of lading)\b")
    balances = text.rlike(r"(?i)\b(balance (brought )?forward|opening balance|closing balance|balance due|running balance|aged|ageing|aging|outstanding)\b")
    named = F.lower(F.array_join(lines, "\n")).contains("statement of account")
    return F.coalesce(first.isNotNull() & ~invoice & (balances | named), F.lit(False))


def guard_cell(x: Column | str) -> Column:
    """A text that a spreadsheet would run as a formula gets a quote before it; numbers stay."""
    c = _col(x)
    return F.when(c.rlike("^[=+\\-@\\t\\r]") & ~c.rlike(r"^[+-]?[0-9][0-9,]*(\.[0-9]+)?$"), F.concat(F.lit("'"), c)).otherwise(c)


def unguard_cell(x: Column | str) -> Column:
    c = _col(x)
    return F.when(c.rlike("^'[=+\\-@\\t\\r]"), F.substr(c, F.lit(2))).otherwise(c)


def sheet_text(rows: Column) -> Column:
    """Text of a sheet (array of rows, arrays of cells): cells joined by ' | ', bars in cells escaped."""
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, cell), " | ")), "\n")


def sheet_rows(text: Column | str) -> Column:
    """Rows of cells of a sheet's text; an empty line is an empty row."""
    cell = lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|")))
    return F.transform(F.split(_col(text), "\n"), lambda s: F.when(F.trim(s) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(s, r" \| "), cell)))


_NUMBER = r"(?i)\b(?:invoice|credit note)\s*(?:no|number|#)\.?\s*:?\s*([A-Z0-9][A-Z0-9/-]*)"
_PAGE = r"(?i)\bpage\s+([0-9]+)\s+of\s+([0-9]+)\b"


def page_starts(pages: Column) -> Column:
    """Which pages (array of texts) begin a new document, as an array of their positions from 0.

    A page continues if it is a later page of several, repeats the document's number or says so; else numbering that starts
    again or a new number count three, a last page before it two, a title, a first number or a total at the end of the page
    before one each, and two points begin a document. The number of the current document is carried along by a fold.
    """

    def info(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(F.coalesce(p, F.lit("")), "\n"), lambda s: F.trim(s)), lambda s: s != "")
        top, tail = F.array_join(F.slice(lines, 1, 6), "\n"), F.array_join(F.reverse(F.slice(F.reverse(lines), 1, 8)), "\n")
        number = F.regexp_extract(p, _NUMBER, 1)
        return F.struct(
            F.when(number.rlike("[0-9]"), norm_ref(number)).otherwise("").alias("number"),
            F.regexp_extract(p, _PAGE, 1).try_cast("int").alias("nth"), F.regexp_extract(p, _PAGE, 2).try_cast("int").alias("of"),
            top.rlike(r"(?i)(?m)^(commercial |freight )?invoice\b|^credit (note|memo)\b|^bill of lading\b").alias("title"),
            top.rlike(r"(?i)\bcontinued\b|\bbrought forward\b").alias("goes_on"),
            tail.rlike(r"(?i)(?m)^(?!.*subtotal).*\btotal\b.*[0-9]+[.,][0-9]{2}").alias("total"),
        )

    page_type = "struct<number:string,nth:int,of:int,title:boolean,goes_on:boolean,total:boolean>"
    every = F.transform(pages, lambda p: info(p).cast(page_type))
    state = f"struct<i:int,number:string,prev:{page_type},at:array<int>>"

    def step(a: Column, cur: Column) -> Column:
        own, prev, first = a["number"], a["prev"], a["i"] == 0
        known = (cur["number"] != "") & (own != "")
        goes_on = F.coalesce(cur["nth"] > 1, F.lit(False)) | (known & (cur["number"] == own)) | cur["goes_on"]
        points = (
            F.when(cur["nth"] == 1, 3).otherwise(0)
            + F.when(known & (cur["number"] != own), 3).when((cur["number"] != "") & (own == ""), 1).otherwise(0)
            + F.when(prev["nth"] == prev["of"], 2).otherwise(0) + cur["title"].cast("int") + F.coalesce(prev["total"], F.lit(False)).cast("int")
        )
        starts = first | (~goes_on & (points >= 2))
        number = F.when(starts | (own == ""), cur["number"]).otherwise(own)
        at = F.when(starts, F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"])
        return F.struct((a["i"] + 1).alias("i"), number.alias("number"), cur.alias("prev"), at.alias("at")).cast(state)

    begin = F.struct(F.lit(0).alias("i"), F.lit("").alias("number"), F.lit(None).alias("prev"), F.array().alias("at")).cast(state)
    return F.aggregate(every, begin, step)["at"]


def listify(x: Column | str) -> Column:
    """A text of several values, separated by commas, semicolons or lines, as an array of trimmed ones without repetitions."""
    parts = F.transform(F.split(F.coalesce(_col(x), F.lit("")), "[,;\\n]"), lambda s: F.trim(s))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def grounded(values: Column, text: Column | str) -> Column:
    """Whether every value of an array is printed in a text, both without punctuation and case; an empty array is."""
    body = norm_ref(text)
    return F.forall(values, lambda v: F.contains(body, norm_ref(v)))


def mentions(x: Column | str) -> Column:
    """Names after an at sign in a comment, in lower case, once each; those within an address don't count."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(r"(?<![A-Za-z0-9._])@([A-Za-z0-9._-]*[A-Za-z0-9_-])"), F.lit(1)), F.lower))


def safe_file_name(x: Column | str, most: int = 120) -> Column:
    """A file name without folders, controls or characters that file systems refuse; 'file' if nothing is left."""
    last = F.element_at(F.split(F.coalesce(_col(x), F.lit("")), r"[/\\\\]"), -1)
    bare = F.regexp_replace(F.regexp_replace(last, r"[\x00-\x1f<>:\"|?*]", ""), r"^[. ]+|[. ]+$", "")
    return F.when(bare == "", "file").otherwise(F.substring(bare, 1, most))


def header_label(x: Column | str) -> Column:
    """A column header for comparing: lower case, anything but letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(_col(x), F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


#: What people read for an issue's code; codes without an entry are spelled out.
ISSUE_TITLES = {"total_mismatch": "Lines don't add up to the total", "duplicate_invoice": "Invoice received before", "amount_outlier": "Unusual amount", "invalid_container": "Container number is wrong", "container_not_on_bl": "Container isn't on the bill of lading"}


def issue_title(code: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ISSUE_TITLES.items() for x in kv])
    words = F.replace(_col(code), F.lit("_"), F.lit(" "))
    return F.coalesce(F.try_element_at(known, _col(code)), F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 200)))


def audit_sentence(actor: Column | str, action: Column | str, subject: Column | str) -> Column:
    """'7 purchase on 12' as a sentence: who did what to which."""
    verb = F.regexp_replace(_col(action), "[._]", " ")
    return F.concat_ws(" ", F.coalesce(_col(actor).cast("string"), F.lit("The system")), F.lit("recorded"), verb, F.lit("on"), _col(subject).cast("string"))


def corrected_value(x: Column | str, kind: Column | str) -> Column:
    """A correction typed by a person, by the kind of its field: struct(value, problem); amounts, dates, currencies and lists are checked."""
    from . import dates, money

    t, k = F.trim(F.coalesce(_col(x), F.lit(""))), _col(kind)
    amount, day = money.parse_money(t).cast("string"), dates.parse_date(t).cast("string")
    value = F.when(k == "amount", amount).when(k == "date", day).when(k == "currency", F.when(F.upper(t).rlike("^[A-Z]{3}$"), F.upper(t))).when(k == "list", F.array_join(listify(t), ", ")).otherwise(t)
    problem = F.when((t != "") & value.isNull(), F.concat(F.lit("is not a valid "), k))
    return F.struct(F.when(t != "", value).alias("value"), problem.alias("problem"))


def label_value(x: Column | str, label: str) -> Column:
    """What a text prints after a label, on its line behind a colon or blanks, or on the next line; null if there is nothing."""
    found = F.regexp_extract(F.coalesce(_col(x), F.lit("")), rf"(?im)^[ \t]*(?:{label})[ \t]*[:#.]?[ \t]*(?:\r?\n)?[ \t]*([^\r\n]+)", 1)
    return F.nullif(F.trim(found), F.lit(""))


def company_line(x: Column | str) -> Column:
    """The first of a text's lines that ends like a company's name."""
    lines = F.transform(F.split(F.coalesce(_col(x), F.lit("")), r"\r?\n"), lambda s: F.trim(s))
    return F.try_element_at(F.filter(lines, lambda s: s.rlike(r"(?i)\b(llc|inc|ltd|limited|corp|corporation|gmbh|co|company|bv|sa|plc)\.?$")), F.lit(1))


def po_numbers(x: Column | str) -> Column:
    """Distinct purchase orders that a text names, normalised, in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(r"(?i)\bP\.?O\.?\s*(?:no|number|#)?\.?\s*[:#-]?\s*([A-Z0-9-]*[0-9][A-Z0-9-]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: norm_ref(p)))


def currency_of(x: Column | str) -> Column:
    """The currency that a text names most, by code or sign; of equal ones the code that sorts first; null if none."""
    t = F.coalesce(_col(x), F.lit(""))
    codes = {"USD": r"\bUSD\b|US\$|\$", "EUR": r"\bEUR\b|€", "GBP": r"\bGBP\b|£", "CNY": r"\bCNY\b|\bRMB\b|¥", "AED": r"\bAED\b"}
    counts = [F.struct(F.regexp_count(t, F.lit(p)).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, p) in enumerate(sorted(codes.items()))]
    top = F.array_max(F.array(*counts))
    return F.when(top["n"] > 0, top["c"])
