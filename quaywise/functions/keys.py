"""Normalised keys: every join on references, vendors, products or charge names goes through these."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that a vendor's key leaves out.
LEGAL_FORMS = r"\b(co|company|ltd|limited|llc|inc|corp|corporation|gmbh|sa|as|bv|plc|pte|pvt)\b\.?"
#: Words that an alias key leaves out, beside numbers.
UNIT_WORDS = (
    r"\b(days?|hrs?|hours?|x|per|each|usd|eur|gbp|cny|aed|at|qty|units?|containers?|boxe?s?|"
    r"20gp|40gp|40hc|45hc|20rf|40rf|20|40|45|hc|gp|dv)\b"
)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def norm_ref(x: Column | str) -> Column:
    """Upper case, letters and digits only: 'oslu 123456-7' -> 'OSLU1234567'. Null becomes ''."""
    return F.regexp_replace(F.upper(F.coalesce(_col(x).cast("string"), F.lit(""))), "[^A-Z0-9]", "")


def vendor_key(x: Column | str) -> Column:
    """Lower case without punctuation and legal forms: 'Harborlink Logistics, LLC' -> 'harborlink logistics'."""
    bare = F.regexp_replace(F.lower(F.coalesce(_col(x), F.lit(""))), "[^a-z0-9 ]+", " ")
    return squeeze(F.regexp_replace(bare, LEGAL_FORMS, " "))


def charge_text(x: Column | str) -> Column:
    """A charge name for matching: lower case, '&' as 'and', anything but letters and digits as one space."""
    lower = F.replace(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def alias_key(x: Column | str) -> Column:
    """A charge name without amounts, counts and units, at most 200 characters."""
    bare = F.regexp_replace(charge_text(x), r"\d+(?:[.,]\d+)*", " ")
    return F.substring(squeeze(F.regexp_replace(bare, UNIT_WORDS, " ")), 1, 200)


def product_key(vendor: Column | str, sku: Column | str, description: Column | str) -> Column:
    """The vendor's key and the SKU, or the description where there is no SKU; at most 260 characters."""
    code = norm_ref(sku)
    words = F.concat(F.lit("d:"), squeeze(F.lower(F.coalesce(_col(description), F.lit("")))))
    return F.substring(F.concat_ws("|", vendor_key(vendor), F.when(code != "", code).otherwise(words)), 1, 260)


def fingerprint(code: Column | str, document: Column | str, key: Column | str) -> Column:
    """Identity of an issue: its code, its document ('-' if none) and the rule's own key."""
    return F.concat_ws(":", _col(code), F.coalesce(_col(document).cast("string"), F.lit("-")), F.coalesce(_col(key).cast("string"), F.lit("")))


def scope(document: Column | str, shipment: Column | str) -> Column:
    """Whose money a catch is: the document's, else the shipment's."""
    own = F.concat(F.lit("d"), _col(document).cast("string"))
    return F.coalesce(own, F.concat(F.lit("s"), F.coalesce(_col(shipment).cast("string"), F.lit("0"))))
