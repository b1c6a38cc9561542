"""Call classification: where does a call send its arguments?

All word tests use ASCII boundaries, written as lookarounds, because Java's ``\\b`` also counts
accented letters as word characters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..dims import BUILTIN, Dictionaries, lookup, one_of, quoted

_NOT_AFTER_WORD = "(?<![A-Za-z0-9_])"
_NOT_BEFORE_WORD = "(?![A-Za-z0-9_])"


def _whole_word(words: list[str] | str) -> str:
    body = words if isinstance(words, str) else "|".join(words)
    return f"{_NOT_AFTER_WORD}({body}){_NOT_BEFORE_WORD}"


PLACEHOLDER_PATTERN = "(?i)" + _whole_word(dims.PLACEHOLDER_WORDS)
COMMS_PATTERN = "|".join(dims.COMMS_WORDS) + "|" + _whole_word(dims.COMMS_WHOLE_WORDS)
URL_HOST_PATTERN = r"https?://([a-zA-Z0-9.\-]+)"


def trim_space(text: Column) -> Column:
    """Strip white space (Unicode) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def split_call(full_text: Column, args_text: Column) -> Column:
    """Callee: the full call text without its argument-list suffix, trimmed."""
    bare = F.when(full_text.endswith(args_text),
                  F.left(full_text, F.length(full_text) - F.length(args_text))).otherwise(full_text)
    return trim_space(bare)


def receiver_of(callee: Column) -> Column:
    """Text before the last ``.``, ``:`` or ``>``; empty if there is none."""
    return F.regexp_extract(trim_space(callee), r"(?s)^(.*)[.:>][^.:>]*\z", 1)


def method_of(callee: Column) -> Column:
    """Text after the last ``.``, ``:`` or ``>``; the whole callee if there is none."""
    return F.regexp_extract(trim_space(callee), r"([^.:>]*)\z", 1)


def is_placeholder(value: Column) -> Column:
    """Is this literal obviously fake (example.com, test, foo, ...)?"""
    return value.rlike(PLACEHOLDER_PATTERN)


def url_host(text: Column) -> Column:
    """Host of the first http(s) URL in a text, empty if there is none."""
    return F.regexp_extract(text, URL_HOST_PATTERN, 1)


def match_vendor(lowered: Column | str, d: Dictionaries = BUILTIN) -> Column:
    """Alphabetically first vendor token contained in a lower-cased text (a column or its name), or
    null. One pattern tells whether there is any; only then the tokens are tried one by one."""
    tokens = sorted(t for t, _ in d.vendors)
    if not tokens:
        return F.lit(None).cast("string")
    text = F.col(lowered) if isinstance(lowered, str) else lowered
    listed = F.expr("array(" + ", ".join(map(quoted, tokens)) + ")")
    any_of = "|".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", t) for t in tokens)
    return F.when(text.rlike(any_of), F.get(F.filter(listed, lambda t: text.contains(t)), F.lit(0)))


def is_comms(lowered_callee: Column) -> Column:
    return lowered_callee.rlike(COMMS_PATTERN)


def is_http(receiver: Column, method: Column) -> Column:
    return ((one_of(method, dims.HTTP_METHODS) & receiver.rlike(_whole_word(dims.HTTP_RECEIVERS)))
            | (method == "fetch"))


def is_log(receiver: Column, method: Column) -> Column:
    return one_of(method, dims.LOG_METHODS) | receiver.rlike(_whole_word(dims.LOG_RECEIVERS))


def is_store(receiver: Column, method: Column) -> Column:
    return one_of(method, dims.STORE_METHODS) & (
        one_of(method, dims.SELF_EVIDENT_STORE_METHODS) | receiver.rlike(_whole_word(dims.STORE_RECEIVERS)))


def store_word(receiver: Column) -> Column:
    """First store word in a receiver; empty if none."""
    return F.regexp_extract(receiver, _whole_word(dims.STORE_RECEIVERS), 1)


def family_of_word(word: Column) -> Column:
    """Family of a store word: cache, object, mongo, dynamo, db; empty for no word."""
    family = F.when(word == "", "")
    for name, (words, _) in dims.STORE_FAMILIES.items():
        family = family.when(one_of(word, words), name)
    return family.when(word.isNotNull(), "db")


def store_family(receiver: Column) -> Column:
    return family_of_word(store_word(receiver))


def store_label(family: Column) -> Column:
    label = F.when(F.lit(False), "")
    for name, (_, text) in dims.STORE_FAMILIES.items():
        label = label.when(family == name, text)
    return label.otherwise(dims.DB_LABEL)


def target_system(kind: Column) -> Column:
    """System shown for a call target of a kind; empty for the other kinds."""
    system = F.when(F.lit(False), "")
    for name, _, text in dims.KINDS:
        if text:
            system = system.when(kind == name, text)
    return system.otherwise("")


def with_target(calls: DataFrame, d: Dictionaries = BUILTIN) -> DataFrame:
    """Add ``target_id``, ``target_label``, ``target_kind``; null where a call goes nowhere known.

    Rules in priority order: vendor, messaging, HTTP (vendor host, plain host, generic), log, store.
    Each term refers to earlier ones by name, so shared terms are computed once. The result comes out
    of a one-row ``inline``, so a later filter on the target reads it instead of pulling a copy of the
    whole rule chain down the plan.
    """
    low, recv, method = F.col("_low"), F.col("_recv"), F.col("_method")
    rule, vendor, host, family = (F.col(c) for c in ("_rule", "_vendor", "_host", "_family"))
    staged = calls.select(
        "*",
        F.lower(trim_space(F.col("callee"))).alias("_low"),
        # receiver up to and with its delimiter: no word, so no word test sees the difference
        F.regexp_extract("_low", "(?s)^(.*[.:>])", 1).alias("_recv"),
        F.substring(low, F.length(recv) + 1, F.length(low)).alias("_method"),
        match_vendor("_low", d).alias("_called"),
        F.when(F.col("_called").isNotNull(), "vendor")
        .when(is_comms(low), "comms")
        .when(is_http(recv, method), "http")
        .when(is_log(recv, method), "log")
        .when(is_store(recv, method), "store").alias("_rule"),
        F.when(rule == "http", url_host(F.col("full_text"))).alias("_url"),
        F.when((F.col("_url") != "") & ~is_placeholder(F.col("_url")), F.col("_url")).alias("_host"),
        F.lower("_host").alias("_lhost"),
        F.coalesce("_called", match_vendor("_lhost", d)).alias("_vendor"),
        F.when(rule == "store", store_word(recv)).alias("_word"),
        family_of_word(F.col("_word")).alias("_family"))
    target = F.struct(
        F.when(vendor.isNotNull(), F.concat(F.lit("ext:"), vendor))
        .when(rule == "comms", "ext:comms")
        .when(rule == "http", F.concat(F.lit("ext:"), F.coalesce(host, F.lit("http"))))
        .when(rule == "log", "sink:log")
        .when(rule == "store", F.concat(F.lit("store:"), F.when(family == "", "db").otherwise(family)))
        .alias("target_id"),
        F.when(vendor.isNotNull(), lookup(d.vendors, vendor))
        .when(rule == "comms", dims.COMMS_LABEL)
        .when(rule == "http", F.coalesce(host, F.lit(dims.HTTP_LABEL)))
        .when(rule == "log", dims.LOG_LABEL)
        .when(rule == "store", F.when(family == "", dims.STORE_LABEL).otherwise(store_label(family)))
        .alias("target_label"),
        F.when(rule.isin("vendor", "comms", "http"), "external")
        .when(rule == "log", "sink").when(rule == "store", "store").alias("target_kind"))
    return staged.select(*calls.columns, F.inline(F.array(target)))
