"""Normalisation of dirty identity keys (e-mail, phone, name) as Column expressions.

Everything here stays on the JVM: no Python function sees a row.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The real mail domains, in order of preference.
KNOWN_DOMAINS = ["gmail.com", "hotmail.com", "outlook.com", "yahoo.com", "icloud.com", "proton.me"]

# Observed misspellings and the domain each one stands for.
DOMAIN_TYPOS = {
    "gmial.com": "gmail.com",
    "gmai.com": "gmail.com",
    "gmail.co": "gmail.com",
    "gnail.com": "gmail.com",
    "hotmial.com": "hotmail.com",
    "hotmai.com": "hotmail.com",
    "hotmal.com": "hotmail.com",
    "hotmail.co": "hotmail.com",
    "outlok.com": "outlook.com",
    "outloo.com": "outlook.com",
    "outlook.co": "outlook.com",
    "yaho.com": "yahoo.com",
    "yahooo.com": "yahoo.com",
    "iclod.com": "icloud.com",
    "icloud.co": "icloud.com",
    "protonme": "proton.me",
    "proton.m": "proton.me",
}

# Words that carry no identity inside a name.
NAME_PARTICLES = ["de", "del", "la", "las", "los", "san", "santa", "da", "do"]

# Fixed value: the country prefix removed from phone numbers.
COUNTRY_PREFIX = "57"


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from Unicode itself."""
    src, dst = [], []
    for lo, hi in ((0x00C0, 0x0250), (0x1E00, 0x1F00)):
        for cp in range(lo, hi):
            ch = chr(cp)
            base = "".join(
                c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn"
            )
            if len(base) == 1 and base != ch:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(s: Column) -> Column:
    """Base letters only; NULL counts as an empty text."""
    s = F.coalesce(s, F.lit(""))
    # most texts are ASCII and skip the table
    return F.when(
        s.rlike(r"[^\x00-\x7F]"),
        F.regexp_replace(F.translate(s, _ACCENTED, _PLAIN), r"\p{Mn}+", ""),
    ).otherwise(s)


def fix_domain(
    dom: Column, known: list[str] | None = None, typos: dict[str, str] | None = None
) -> Column:
    """Typo table first, then the known domains, then the first known one an edit away."""
    known = KNOWN_DOMAINS if known is None else known
    typos = DOMAIN_TYPOS if typos is None else typos
    by_target: dict[str, list[str]] = {}
    for typo, target in typos.items():
        by_target.setdefault(target, []).append(typo)
    out = F.when(dom.isin(known), dom)
    for target, variants in by_target.items():
        out = out.when(dom.isin(variants), F.lit(target))
    for d in known:
        out = out.when(F.levenshtein(dom, F.lit(d), 1) >= 0, F.lit(d))
    return out.otherwise(dom)


def email_text(email: Column) -> Column:
    return F.lower(F.regexp_replace(strip_accents(email), r"^\s+|\s+$", ""))


def email_local(text: Column) -> Column:
    """Mailbox part of a cleaned e-mail, without the +alias; the whole text if there is no @."""
    head = F.regexp_extract(text, r"(?s)^(.*)@[^@]*$", 1)
    return F.when(text.contains("@"), F.split_part(head, F.lit("+"), F.lit(1))).otherwise(text)


def email_domain(text: Column, **tables) -> Column:
    raw = F.substring_index(text, "@", -1)
    return F.when(text.contains("@"), fix_domain(raw, **tables)).otherwise(F.lit(""))


def local_core(local: Column) -> Column:
    """Mailbox without punctuation and without trailing digits."""
    return F.regexp_replace(
        F.regexp_replace(F.coalesce(local, F.lit("")), r"[._\-]", ""), r"[0-9]+$", ""
    )


def norm_phone(phone: Column) -> Column:
    """Last ten digits without the country prefix; empty when there are fewer."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^0-9]", "")
    # the prefix goes only from numbers longer than ten digits
    national = F.regexp_replace(digits, f"^{COUNTRY_PREFIX}(?=[0-9]{{9}})", "")
    return F.regexp_extract(national, r"([0-9]{10})$", 1)


def adjacent_swaps(s: Column) -> Column:
    """Every variant with two different neighbouring characters exchanged."""
    swapped = F.transform(
        F.sequence(F.lit(1), F.length(s) - 1),
        lambda i: F.concat(
            F.substr(s, F.lit(1), i - 1),
            F.substr(s, i + 1, F.lit(1)),
            F.substr(s, i, F.lit(1)),
            F.substr(s, i + 2),
        ),
    )
    return F.when(
        F.length(s) >= 2, F.array_distinct(F.filter(swapped, lambda t: t != s))
    ).otherwise(F.array().cast("array<string>"))


def deletions(s: Column) -> Column:
    """Every variant with one character removed."""
    return F.when(
        F.length(s) >= 1,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.length(s)),
                lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))


def name_tokens(name: Column) -> Column:
    words = F.regexp_replace(F.lower(strip_accents(name)), r"[^a-z\s]", " ")
    return F.filter(
        F.split(words, r"\s+"), lambda t: (t != "") & ~t.isin(NAME_PARTICLES)
    )


def name_key(name: Column) -> Column:
    """Sorted tokens as one text (duplicates kept)."""
    return F.array_join(F.array_sort(name_tokens(name)), " ")


def name_set(name: Column) -> Column:
    """Sorted distinct tokens."""
    return F.array_sort(F.array_distinct(name_tokens(name)))


def name_similarity(sale: Column, user: Column) -> Column:
    """Share of the user's tokens found in the sale's, 0..1, on two token sets.

    A token counts 1 when equal, 0.9 when a token longer than three letters is at
    most one edit away, 0.5 when the sale has just its initial. More than one
    surplus sale token costs 0.15 each.
    """
    rest_user = F.array_except(user, sale)
    rest_sale = F.array_except(sale, user)

    def typo(tu):
        return F.exists(
            rest_sale, lambda ts: (F.length(ts) > 3) & (F.levenshtein(ts, tu, 1) >= 0)
        )

    def initial(tu):
        return F.exists(rest_sale, lambda ts: (F.length(ts) == 1) & tu.startswith(ts))

    n_typo = F.size(F.filter(rest_user, typo))
    has_initial = F.exists(sale, lambda t: F.length(t) == 1)
    n_initial = F.when(
        has_initial, F.size(F.filter(rest_user, lambda t: ~typo(t) & initial(t)))
    ).otherwise(F.lit(0))
    n_equal = F.size(user) - F.size(rest_user)
    covered = n_equal + F.lit(0.9) * n_typo + F.lit(0.5) * n_initial
    surplus = F.greatest(F.lit(0), F.size(sale) - F.size(user) - 1)
    partial = F.greatest(
        F.lit(0.0), F.least(F.lit(1.0), covered / F.size(user) - F.lit(0.15) * surplus)
    )
    return (
        F.when((F.size(sale) == 0) | (F.size(user) == 0), F.lit(0.0))
        .when(sale == user, F.lit(1.0))
        .otherwise(partial)
    )


def name_block_keys(tokens: Column, side: str) -> Column:
    """Keys (with the token behind each) that two token sets share whenever their
    similarity is above zero: "t:" equal token, "d:" one edit apart, "1:" initial."""

    def entry(kind: str, text: Column, token: Column) -> Column:
        return F.struct(F.concat(F.lit(kind), text).alias("sub"), token.alias("tok"))

    equal = F.transform(tokens, lambda t: entry("t:", t, t))
    edits = F.flatten(
        F.transform(
            tokens,
            lambda t: F.transform(F.concat(F.array(t), deletions(t)), lambda d: entry("d:", d, t)),
        )
    )
    if side == "user":
        initials = F.transform(tokens, lambda t: entry("1:", F.substr(t, F.lit(1), F.lit(1)), t))
    else:
        initials = F.transform(
            F.filter(tokens, lambda t: F.length(t) == 1), lambda t: entry("1:", t, t)
        )
    return F.concat(equal, edits, initials)
