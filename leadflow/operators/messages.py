"""Jobs over a table of chat messages (msg_id, text).

The source system ran these on one message at a time; here each is a plan over the
whole message log.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.products import ALL_PRODUCTS_PHRASES

# Agent code pattern (letters then digits, as whole words).
AGENT_CODE_PATTERN = r"\b[A-Za-z]{1,6}\d{2,8}\b"

# Words that send a longer message to the business-logic route.
LOGIC_KEYWORDS = ("who", "what", "when", "where", "why", "how", "compare", "trend", "define", "consider",
                  "logic", "calculate", "based on", "if", "and", "or", "but", "is not null", "is null",
                  "not in", ">", "<", "=", "!=")

# Phrases that introduce a rule to remember, in the order they are tried.
RULE_PHRASES = ("for future understand", "remember that", "the logic should be", "for future reference")

# Words that mark a message as feedback.
FEEDBACK_WORDS = ("should", "should have", "supposed to", "must", "always", "include", "exclude", "prefer",
                  "use like", "use regex", "use ", "filter by", "group by", "remove product", "wrong",
                  "incorrect", "show", "please add", "please use", "make sure", "instead")

#: A run of word characters of any script (letters, marks, digits, underscore).
WORD = r"[\p{L}\p{M}\p{N}_]+"

#: Of the alias catalog, which every task holds.
MAX_ALIASES = 100_000

SIMPLE, LOGIC = "simple_metric", "business_logic"


def _any_contains(text: Column, needles) -> Column:
    return reduce(or_, [text.contains(F.lit(n)) for n in needles])


def product_tags(messages: DataFrame, aliases: DataFrame, min_alias_len: int = 3) -> DataFrame:
    """(msg_id, product_id) for every alias (3+ characters) found as a whole word or phrase.

    A message saying "all products" (or the like) names no product.  An alias is found where
    it stands in the lower-cased text with no word character joined to its word ends, in any
    script.  The alias catalog is small (``MAX_ALIASES`` at most, else this raises): the first words
    of the aliases meet each message's words in its own row, and the few that both have are looked
    up in the broadcast catalog beside the text, so no text is shuffled; only the ids found are,
    to make them distinct.  An alias without any word character has the empty first word, which
    every message has."""
    al = (aliases.where(F.length("alias") >= min_alias_len)
          .select("product_id", F.lower("alias").alias("a")).withColumn("tok", F.regexp_extract("a", WORD, 0)))
    too_many = F.raise_error(F.lit(f"more than {MAX_ALIASES} aliases"))
    firsts = al.agg(F.when(F.count(F.lit(1)) > MAX_ALIASES, too_many).otherwise(F.collect_set("tok")).alias("toks")).scalar()
    msgs = messages.select("msg_id", F.lower("text").alias("t"))
    msgs = msgs.where(~_any_contains(F.col("t"), ALL_PRODUCTS_PHRASES))
    words = F.concat(F.regexp_extract_all("t", F.lit(WORD), 0), F.array(F.lit("")))
    near = msgs.select("msg_id", "t", F.explode(F.array_intersect(words, firsts)).alias("tok"))
    return (near.join(F.broadcast(al), "tok").where(_stands_in(F.col("t"), F.col("a")))
            .select("msg_id", "product_id").distinct())


def _stands_in(text: Column, alias: Column) -> Column:
    """``alias`` occurs in ``text`` with no word character joined to its word ends."""
    one = WORD.rstrip("+")
    wordy = lambda c: F.regexp_like(c, F.lit(f"^{one}$"))
    before = F.when(wordy(F.substring(alias, 1, 1)), f"(?<!{one})").otherwise("")
    after = F.when(wordy(F.substring(alias, -1, 1)), f"(?!{one})").otherwise("")
    quoted = F.concat(F.lit(r"\Q"), F.replace(alias, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.regexp_like(text, F.concat(before, quoted, after))


def agent_codes(messages: DataFrame) -> DataFrame:
    """(msg_id, code): every distinct agent code written in a message.

    Codes are de-duplicated inside each message's array, so there is no shuffle; this
    equals a ``distinct()`` on (msg_id, code) as long as message ids are unique."""
    codes = F.array_distinct(F.regexp_extract_all("text", F.lit(AGENT_CODE_PATTERN), 0))
    return messages.select("msg_id", F.explode(codes).alias("code"))


def route(text: Column, lowered: Column | None = None) -> Column:
    """``simple_metric`` for two words or fewer, else ``business_logic`` if any keyword is a
    substring of the lower-cased text, else ``simple_metric``.

    "More than two words" is one anchored search for a third word that never backs up, so a
    long unbroken text costs one pass."""
    t = F.lower(text) if lowered is None else lowered
    return (F.when(~text.rlike(r"^\s*+\S++\s++\S++\s++\S"), F.lit(SIMPLE))
            .when(_any_contains(t, LOGIC_KEYWORDS), F.lit(LOGIC))
            .otherwise(F.lit(SIMPLE)))


def routes(messages: DataFrame) -> DataFrame:
    m = messages.select("msg_id", "text", F.lower("text").alias("_t"))     # lower-case once
    return m.select("msg_id", route(F.col("text"), F.col("_t")).alias("route"))


def route_counts(messages: DataFrame) -> DataFrame:
    return routes(messages).groupBy("route").agg(F.count(F.lit(1)).alias("messages"))


def _strip(c: Column) -> Column:
    """Remove leading and trailing white space (blank, tab, line breaks, form feeds)."""
    return F.btrim(c, F.lit(" \t\n\r\f\u000b"))


def rule_text(text: Column, lowered: Column | None = None) -> Column:
    """Text after the first rule phrase present (phrases tried in order, found case-blind,
    cut from the original text, blanks stripped); NULL if no phrase occurs."""
    low = F.lower(text) if lowered is None else lowered
    picks = []
    for phrase in RULE_PHRASES:
        pos = F.instr(low, phrase)
        picks.append(F.when(pos > 0, _strip(F.substr(text, pos + F.lit(len(phrase))))))
    return F.coalesce(*picks)


def rules(messages: DataFrame) -> DataFrame:
    """(msg_id, user_id, rule_text) for messages carrying a non-empty rule."""
    m = messages.select("msg_id", "user_id", "text", F.lower("text").alias("_t"))
    r = m.select("msg_id", "user_id", rule_text(F.col("text"), F.col("_t")).alias("rule_text"))
    return r.where(F.col("rule_text").isNotNull() & (F.col("rule_text") != F.lit("")))


def feedback_like(text: Column) -> Column:
    return _any_contains(F.lower(text), FEEDBACK_WORDS)
