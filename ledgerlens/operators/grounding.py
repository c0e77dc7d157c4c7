"""Facts as sentences, values in text, and claims that no cited fact supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ranking import exact_rank, first_per_root
from ledgerlens.session import shared_checkpoint

# What counts as an identifier, a date, a number, a citation and a recommendation in text.
LETTER_OR_DIGIT = r"[\p{L}\p{N}_]"
START, END = rf"(?<!{LETTER_OR_DIGIT})", rf"(?!{LETTER_OR_DIGIT})"
IDENTIFIER = rf"{START}[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+{END}"
ISO_DATE = rf"{START}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{END}"
NUMBER = r"(?<![\p{L}\p{N}_.])-?[0-9][0-9,]*(?:\.[0-9]+)?"
CITATION = rf"\[?{START}[FET][0-9]+{END}\]?"
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DAY = r"[0-9]{1,2}(?:st|nd|rd|th)?"
LONG_DATE = rf"(?i){START}(?:{DAY}\s+{MONTH}\.?,?\s+[0-9]{{4}}|{MONTH}\.?\s+{DAY},?\s+[0-9]{{4}}){END}"
RECOMMENDATION = (
    r"(?i)\b(?:we|i)\s+(?:recommend|suggest|advise)\b|\brecommend(?:s|ed|ation)?\b|"
    r"\bshould\s+(?:be\s+)?(?:renew|terminat|consolidat|replac|exit|cut|reduc|extend|switch|cancel)\w*"
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def blank(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, " ")


def number_key(text: Column) -> Column:
    """A number's canonical text, equal for equal numbers of any length: no commas, no idle zeros."""
    plain = F.regexp_replace(text, ",", "")
    whole = F.regexp_extract(plain, "^-?0*([0-9]*)", 1)
    fraction = F.regexp_extract(plain, r"\.([0-9]*?)0*\z", 1)
    size = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))
    return F.when(plain.startswith("-") & (size != "0"), F.concat(F.lit("-"), size)).otherwise(size)


def long_date_iso(text: Column) -> Column:
    """ISO form of a date written with a month name."""
    lowered = F.lower(text)
    name = F.regexp_extract(lowered, "([a-z]{3})[a-z]*", 1)
    day_first = lowered.rlike("^[0-9]")
    word = F.when(day_first, F.regexp_extract(lowered, r"^[0-9]{1,2}(?:st|nd|rd|th)?\s+([a-z]{3})", 1)).otherwise(name)
    day = F.when(day_first, F.regexp_extract(lowered, "^([0-9]{1,2})", 1)).otherwise(F.regexp_extract(lowered, r"\s([0-9]{1,2})", 1))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), word)
    return F.format_string("%s-%02d-%02d", F.regexp_extract(lowered, r"([0-9]{4})\z", 1), month, day.cast("int"))


def extract_values(texts: DataFrame, key: str, text: str, source: str = "fact") -> DataFrame:
    """Distinct (key, kind, value) of whole texts: identifiers, ISO dates and numbers.

    Identifiers and dates are taken out before numbers are read. In facts a date also counts as its year,
    month and day, and a number also as its size without sign. In claims (``source="claim"``) citations
    are dropped first and dates written with month names become ISO dates.
    """
    body = F.col(text)
    long_dates = F.array().cast("array<string>")
    if source == "claim":
        body = blank(body, CITATION)
        long_dates = F.transform(all_matches(body, LONG_DATE), long_date_iso)
        body = blank(body, LONG_DATE)
    prepared = texts.select(F.col(key), body.alias("_body"), long_dates.alias("_long"))
    numbers_in = blank(blank(F.col("_body"), IDENTIFIER), ISO_DATE)
    kinds = prepared.select(
        key, all_matches(F.col("_body"), IDENTIFIER).alias("_ids"), F.concat(all_matches(F.col("_body"), ISO_DATE), F.col("_long")).alias("_dates"),
        F.transform(all_matches(numbers_in, NUMBER), number_key).alias("_numbers"),
    )
    numbers = F.col("_numbers")
    if source == "fact":
        parts = F.flatten(F.transform("_dates", lambda d: F.transform(F.split(d, "-"), number_key)))
        numbers = F.concat(numbers, F.transform(numbers, lambda n: F.regexp_replace(n, "^-", "")), parts)
    rows = F.concat(
        F.transform(F.array_distinct("_ids"), lambda v: F.struct(F.lit("id").alias("kind"), v.alias("value"))),
        F.transform(F.array_distinct("_dates"), lambda v: F.struct(F.lit("date").alias("kind"), v.alias("value"))),
        F.transform(F.array_distinct(numbers), lambda v: F.struct(F.lit("number").alias("kind"), v.alias("value"))),
    )
    return kinds.select(key, F.inline(rows))


def summary_citations(citations: DataFrame, answers: DataFrame, claim: str = "claim_id", summary: str = "summary_id", card: str = "card_id") -> DataFrame:
    """The citations with those of summaries: a summary (``answers`` maps it to its claims) cites every card they cite."""
    whole = citations.join(answers.select(claim, summary), claim).select(F.col(summary).alias(claim), card)
    return citations.select(claim, card).unionByName(whole).distinct()


def unsupported_claims(
    claims: DataFrame, cards: DataFrame, citations: DataFrame, claim: str = "claim_id", card: str = "card_id", text: str = "text", questions: DataFrame | None = None
) -> DataFrame:
    """Problems in claims: values that no cited card holds, and recommendations.

    A date or number must occur in a cited card; an identifier only in some card. What the claim's question
    (``questions``: claim and text) holds needs no card. Where another card holds the value, up to three are named. The cards of a value are looked up by value and cut to three
    before they are joined, so a value held by very many cards stays cheap.
    """
    # Extracted once and stored: the values are far smaller than the texts and are joined several times.
    wanted = shared_checkpoint(extract_values(claims, claim, text, "claim"))
    held = shared_checkpoint(extract_values(cards, card, text, "fact"))
    cited = citations.join(held, card).select(claim, "kind", "value").distinct()
    in_some = held.filter("kind = 'id'").select("kind", "value").distinct()
    loose = wanted.filter("kind <> 'id'").join(cited, [claim, "kind", "value"], "left_anti")
    unknown = wanted.filter("kind = 'id'").join(in_some, ["kind", "value"], "left_anti")
    missing = loose.unionByName(unknown.select(*loose.columns))
    if questions is not None:
        missing = missing.join(extract_values(questions, claim, text, "fact"), [claim, "kind", "value"], "left_anti")
    looked_for = missing.select("kind", "value").distinct()
    holders = first_per_root(held.join(looked_for, ["kind", "value"], "left_semi"), ["kind", "value"], [card], 3)
    hints = holders.groupBy("kind", "value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.col(card))), lambda c: c.cast("string")), ",").alias("held_by"))
    problems = missing.join(hints, ["kind", "value"], "left").select(claim, F.concat(F.lit("unsupported_"), F.col("kind")).alias("problem"), "value", F.coalesce("held_by", F.lit("")).alias("held_by"))
    advice = claims.filter(F.col(text).rlike(RECOMMENDATION)).select(claim, F.lit("recommendation").alias("problem"), F.lit("").alias("value"), F.lit("").alias("held_by"))
    return problems.unionByName(advice)


def fact_cards(facts: DataFrame, key: str, templates: dict[str, Column], evidence: DataFrame | None = None) -> DataFrame:
    """One sentence per subject and topic, with at most three evidence ids.

    ``templates`` maps topics to sentence expressions; ``evidence`` has the key, a topic and an evidence_id.
    """
    cards = F.array(*[F.struct(F.lit(topic).alias("topic"), sentence.alias("text")) for topic, sentence in templates.items()])
    long = facts.select(key, F.inline(cards)).filter("text IS NOT NULL")
    if evidence is None:
        return long.withColumn("evidence_ids", F.array().cast("array<string>"))
    first = first_per_root(evidence.select(key, "topic", "evidence_id").distinct(), [key, "topic"], ["evidence_id"], 3)
    named = first.groupBy(key, "topic").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
    return long.join(named, [key, "topic"], "left")


def money_text(value: Column) -> Column:
    return F.coalesce(F.format_number(value, 2), F.lit("unavailable"))


def value_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("unavailable"))


def number_evidence(items: DataFrame, content: list[str], order: str) -> DataFrame:
    """Distinct evidence numbered by first occurrence; ranks are computed in parallel."""
    first = items.groupBy(*content).agg(F.min(order).alias("first_seen"))
    return exact_rank(first, ["first_seen"], (), "evidence_no")


TOKEN = rf"(?i){START}[A-Z]{{1,6}}(?:-[A-Z]{{1,4}})?-[0-9]{{2,6}}(?:-[A-Z]?[0-9]{{1,6}})*{END}"


def text_identifiers(texts: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """Business identifiers in whole texts with the first class (by name) whose pattern they match."""
    tokens = F.array_distinct(F.transform(all_matches(F.col(text), TOKEN), lambda t: F.upper(t)))
    found = texts.select(key, F.explode(tokens).alias("identifier"))
    kind = F.coalesce(*[F.when(F.col("identifier").rlike(f"^(?:{p})\\z"), F.lit(name)) for name, p in sorted(patterns.items())])
    return found.withColumn("class_id", kind).filter("class_id IS NOT NULL")


def resolve_mentions(mentions: DataFrame, master: DataFrame, identity: str = "vendor_id", name: str = "vendor_name", mention: str = "mention") -> DataFrame:
    """Resolve mentions against identifiers and names, ignoring case.

    An exact identifier or name wins. Otherwise names that contain the mention are candidates. Containment
    is an equality join of the mention with the substrings of the names (names are short, mentions are
    looked up once), so no mention is compared with every name.
    """
    asked = mentions.select(F.lower(F.trim(mention)).alias("asked")).filter("asked <> ''").distinct()
    names = master.select(F.col(identity).cast("string").alias("id"), F.lower(name).alias("name"))
    exact = names.select("id", F.explode(F.array_distinct(F.array(F.lower("id"), "name"))).alias("asked"))
    hit = asked.join(exact, "asked").groupBy("asked").agg(F.count("*").alias("exact_count"), F.min("id").alias("exact_id"))
    open_mentions = asked.join(hit.filter("exact_count = 1"), "asked", "left_anti")
    lengths = open_mentions.select(F.length("asked").alias("size")).distinct()
    sized = names.filter("name <> ''").select("id", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("size")).join(lengths, "size", "left_semi")
    cut = sized.select("id", F.explode(F.sequence(F.lit(1), F.length("name") - F.col("size") + 1)).alias("at"), "name", "size")
    pieces = cut.select("id", F.substr("name", F.col("at"), F.col("size")).alias("asked")).join(open_mentions, "asked", "left_semi").distinct()
    near = pieces.groupBy("asked").agg(F.count("*").alias("near_count"))
    joined = asked.join(hit, "asked", "left").join(near, "asked", "left")
    one = F.col("exact_count") == 1
    candidates = F.when(one, 1).when(F.col("exact_count") > 1, F.col("exact_count")).otherwise(F.coalesce("near_count", F.lit(0)))
    return joined.select(
        F.col("asked").alias("mention"), F.when(one, "resolved").when(candidates > 0, "clarification").otherwise("not_found").alias("status"), F.when(one, F.col("exact_id")).alias("resolved_id"), candidates.alias("candidate_count")
    )
