"""Identifier classification: which personal-data category does a name stand for?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import BUILTIN, Dictionaries, lookup, one_of

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def identifiers(snippet: Column) -> Column:
    """Every identifier in a snippet, string contents and nested calls included, in order."""
    return F.regexp_extract_all(snippet, F.lit(f"({IDENTIFIER})"), F.lit(1))


def identifier_tokens(identifier: Column) -> Column:
    """Lower-case word tokens of an identifier, split at case changes and ``_ - . /``."""
    spaced = F.regexp_replace(identifier, "([a-z0-9])([A-Z])", "$1 $2")
    flat = F.lower(F.translate(spaced, "_-./", "    "))
    return F.filter(F.split(flat, r"(?U)\s+"), lambda t: t != "")


def classify_tokens(tokens: Column, d: Dictionaries = BUILTIN, in_parts: bool = False) -> Column:
    """Category id named by a token array, or null. ``in_parts`` leaves out the joined look-up.

    The joined tokens are looked up first; then, left to right, the first token that is in the
    dictionary, or is ``name`` / ``address`` next to one of its qualifiers.
    """
    pairs = [(t, cid) for t, cid, _, _ in d.pii_tokens]

    def beside(i: Column, qualifiers: list[str]) -> Column:
        return (F.coalesce(one_of(F.get(tokens, i - 1), qualifiers), F.lit(False))
                | F.coalesce(one_of(F.get(tokens, i + 1), qualifiers), F.lit(False)))

    def by_token(t: Column, i: Column) -> Column:
        qualified = F.when((t == "name") & beside(i, d.name_qualifiers), F.lit("name")).when(
            (t == "address") & beside(i, d.address_qualifiers), F.lit("address"))
        return F.coalesce(lookup(pairs, t), qualified)

    per_token = F.get(F.filter(F.transform(tokens, by_token), lambda c: c.isNotNull()), F.lit(0))
    return per_token if in_parts else F.coalesce(lookup(pairs, F.array_join(tokens, "")), per_token)


def classify_identifier(identifier: Column, d: Dictionaries = BUILTIN) -> Column:
    """Category id of one identifier, or null when it names no personal data."""
    return classify_tokens(identifier_tokens(identifier), d)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def categories_in(snippet: Column, d: Dictionaries = BUILTIN) -> Column:
    """Distinct category ids named by the identifiers of a snippet, in first-seen order.

    Same answer as ``classify_identifier`` on each identifier, but case changes are marked once for
    the whole snippet: identifiers are ASCII, so a case change is written as one more ``_``.
    """
    marked = F.translate(F.regexp_replace(snippet, "([a-z0-9])([A-Z])", "$1_$2"), _UPPER, _UPPER.lower())
    names = F.regexp_extract_all(marked, F.lit("([a-z_][a-z0-9_]*)"), F.lit(1))

    pairs = [(t, cid) for t, cid, _, _ in d.pii_tokens]

    def by_position(tokens: Column) -> Column:
        return classify_tokens(tokens, d, in_parts=True)

    def one_name(name: Column) -> Column:
        split = F.array(F.filter(F.split(name, "_"), lambda t: t != ""))
        # a name of one token was looked up whole; only longer ones go token by token
        return F.coalesce(lookup(pairs, F.replace(name, F.lit("_"), F.lit(""))),
                          F.when(name.contains("_"), F.get(F.transform(split, by_position), F.lit(0))))

    found = F.transform(F.array_distinct(names), one_name)
    return F.array_distinct(F.filter(found, lambda c: c.isNotNull()))
