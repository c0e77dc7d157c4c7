"""Surrogates for personal data, in DataFrame expressions only.

Entities are found by pattern: e-mail addresses, access keys, secrets after words such as ``password=``, IBANs,
IPv4 addresses, telephone numbers, social security numbers, card numbers, and names after a title. Each is
replaced by a value of the same type that depends on a key: letters become letters of the same case, digits
digits, separators, length, key prefix, country prefix and top-level domain stay; hexadecimal stays
hexadecimal; a card number keeps its issuer digit and its check-digit residue; parts of an address stay in
range; a name keeps its title, its number of words, its case and its script (Latin, Greek or Cyrillic) and gets
given names of the gender of its titles.

An entity is made of parts that are replaced one by one. A name's last word is a surname and the words before it
are given names, without the title, so "Mr John Smith", "Mr Smith" and "Dr John Smith" share their surrogates. The
gender of a given name is the one of its titles in the whole corpus; a name that stands after titles of both
genders gets a unisex one. An e-mail address has its domain, an entity of its own, and a user within the domain.
Names are found after titles only.

Equal parts get equal surrogates in all documents and formats, since the surrogate is made from the canonical
value (lower case, separators dropped where they carry nothing). Different parts keep different surrogates: those
that would share one, or would equal a value found in the corpus (given names, which are no person by themselves,
may), are found by grouping and given further attempts until none is left. Given names become longer by a further
name at each attempt. Others become longer in attempts beyond ``PLAIN``, by one character (a surname: by a
syllable) each, so the search ends however many values a type has; only addresses of four parts keep their form,
with 2^32 surrogates. Only what is tried again, and given names without one gender, need a join; all others are
computed in place.

Defined cases: a key or secret has a letter or digit, so fields of punctuation alone (``password: ________``) stay; null and empty texts stay as they are; a text without entities is returned unchanged byte for
byte; repeated rows get equal texts; an empty table gives an empty result; further columns pass through,
whatever their names (``n_entities`` is replaced by the count, ``n_chars`` follows the text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import boxed, documents, store, unboxed

KEY = "corpus-surrogates"
#: Attempts that keep a value's length.
PLAIN = 3
#: Titles by gender, given names by gender and script, syllables by script.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Signora", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof", "Professor", "Doctor"),
}
GIVEN = {
    "latin": {"m": "Adam Boris Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul", "f": "Anna Berta Clara Diana Emma Flora Greta Helena Ida Julia Karla Lena Maria Nora Olga Paula", "n": "Alex Robin Kim Sascha Charlie Luca Noel Sam"},
    "greek": {"m": "Νίκος Γιάννης Πέτρος Παύλος", "f": "Μαρία Ελένη Άννα Σοφία", "n": "Άλεξ Χρις Σαμ Ρένα"},
    "cyrillic": {"m": "Иван Пётр Павел Олег", "f": "Анна Мария Ольга Елена", "n": "Саша Женя Валя Слава"},
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no",
    "greek": "βα βε βι βο γα γε γι γο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο",
    "cyrillic": "ба бе би бо ва ве ви во га ге ги го да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но",
}
_TITLE = "|".join(t for g in TITLES.values() for t in g)
_PREFIX = "(?:AKIA|ASIA|ghp_|gho_|xoxb-|sk_live_|sk-)(?=[_-]*[A-Za-z0-9])"
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "key": rf"(?<![A-Za-z0-9]){_PREFIX}[A-Za-z0-9_-]{{12,}}",
    "secret": r"(?<=(?:password|passwd|pwd|secret|token|api[_-]key|apikey)[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?)(?=[+/_.-]*[A-Za-z0-9])[A-Za-z0-9+/_.-]{8,}",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}",
}
#: Every pattern needs a digit, an @, a secret's word or a title, but for keys, which may be letters alone.
HINT = rf"[@0-9]|{PATTERNS['key']}|(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']? {{0,3}}[=:]|(?<![\p{{L}}])(?:{_TITLE})\.? \p{{Lu}}"
_ANY = "|".join(PATTERNS.values())
#: Marks entities in the text; the first character is escaped where a text has it.
_ESCAPE, _MARK, _PLAIN = "﷐", "﷐﷑", "﷐﷒"


def pieces(text: Column) -> Column:
    """The text cut at its entities: every second element is one."""
    return F.split(F.regexp_replace(F.replace(text, F.lit(_ESCAPE), F.lit(_PLAIN)), _ANY, f"{_MARK}$0{_MARK}"), _MARK)


def kind(value: Column) -> Column:
    """The type of an entity, from its own form; titles give the gender of a name."""
    # A secret of few digits among separators is none of the numbers.
    digits = r"^(?=(?:[ -]*[0-9]){8})[0-9 -]+$"
    out = F.when(value.contains("@"), "email").when(value.rlike(rf"^{_PREFIX}[A-Za-z0-9_-]+$"), "key")
    for gender, titles in TITLES.items():
        out = out.when(value.rlike(rf"^(?:{'|'.join(titles)})\.? \p{{Lu}}"), f"name_{gender}")
    out = out.when(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip").when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    out = out.when(value.rlike(r"^\+(?:[ .()-]*[0-9]){6,}$|^\(|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), "phone").when(value.rlike(digits), "card")
    return out.when(value.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{12,}$"), "iban").otherwise("secret")


def canonical(of: Column, value: Column) -> Column:
    """What stands for all formats of an entity."""
    bare = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    name = F.lower(F.regexp_replace(value, rf"^(?:{_TITLE})\.? ", ""))
    return F.when(of == "email", F.lower(value)).when(of.startswith("name"), name).when(of.isin("phone", "card", "iban", "ssn"), bare).otherwise(value)


def parts(entity: Column) -> Column:
    """The (type, value) pairs an entity is replaced by: one, but for e-mail addresses and names.

    A given name's type ends with the gender of the title.
    """

    def split(x):
        value = canonical(x["of"], entity)
        part = lambda of, v: F.struct(of.alias("type"), v.alias("value"))
        words = F.split(value, " ")
        named = F.transform(words, lambda w, i: part(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), F.substring(x["of"], 6, 1))), w))
        email = F.array(part(F.lit("email"), value), part(F.lit("domain"), F.substring_index(value, "@", -1)))
        return F.when(x["of"] == "email", email).when(x["of"].startswith("name"), named).otherwise(F.array(part(x["of"], value)))

    return _let(F.struct(kind(entity).alias("of")), split)


def family(of: Column) -> Column:
    """Types whose surrogates must differ from each other: given names of all genders are one family."""
    return F.when(of.startswith("given"), F.lit("given")).otherwise(of)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _pick(seed: Column, i: Column, options) -> Column:
    options = list(options)
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(seed, i), F.lit(len(options))) + 1).cast("int"))


def _number(seed: Column, i: Column, low: int, high: int) -> Column:
    return (F.pmod(F.xxhash64(seed, i), F.lit(high - low + 1)) + low).cast("string")


def _more(seed: Column, n: Column, options="0123456789") -> Column:
    """What makes a surrogate longer: ``n`` further elements."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(seed, i + 1000, options)), "")).otherwise("")


def _letters(seed: Column, value: Column, keep: int = 0, hexadecimal: Column | None = None) -> Column:
    """Letters for letters, digits for digits; the first ``keep`` characters and all others stay."""

    def one(c, i):
        lower, upper = _pick(seed, i, "abcdefghijklmnopqrstuvwxyz"), _pick(seed, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        if hexadecimal is not None:
            lower, upper = F.when(hexadecimal, _pick(seed, i, "abcdef")).otherwise(lower), F.when(hexadecimal, _pick(seed, i, "ABCDEF")).otherwise(upper)
        return F.when(i < keep, c).when(c.between("0", "9"), _number(seed, i, 0, 9)).when(c.between("a", "z"), lower).when(c.between("A", "Z"), upper).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a digit string, modulo 10."""
    n = F.length(digits)
    worth = lambda c, i: F.when(F.pmod(n - 1 - i, F.lit(2)) == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0))
    return F.pmod(F.aggregate(F.transform(F.split(digits, ""), worth), F.lit(0), lambda s, x: s + x), F.lit(10))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _by_script(value: Column, made) -> Column:
    """``made(script)`` for the script of a word."""

    def choose(script):
        out = made("latin")
        for other in ("greek", "cyrillic"):
            out = F.when(script == other, made(other)).otherwise(out)
        return out

    return _let(_script(value), choose)


def _surname(value: Column, seed: Column, more: Column) -> Column:
    """Four made-up syllables and more, in lower case."""

    def made(script):
        syllables = SYLLABLES[script].split()
        return F.concat(*(_pick(seed, F.lit(j), syllables) for j in range(4)), _more(seed, more, syllables))

    return _by_script(value, made)


def _given(of: Column, value: Column, seed: Column, attempt: Column) -> Column:
    """One given name of the gender, and one more for each attempt, hyphenated and in lower case."""

    def made(script):
        name = lambda i: F.when(of == "given_m", _pick(seed, i, GIVEN[script]["m"].split())).when(of == "given_f", _pick(seed, i, GIVEN[script]["f"].split())).otherwise(_pick(seed, i, GIVEN[script]["n"].split()))
        return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), attempt), name), "-"))

    return _by_script(value, made)


def surrogate(of: Column, value: Column, attempt: Column, key: str = KEY) -> Column:
    """The canonical surrogate of a part's canonical value."""
    seed = F.xxhash64(F.sha2(F.concat_ws("|", F.lit(key), of, value, attempt.cast("string")), 256))
    known = F.struct(of.alias("of"), value.alias("value"), seed.alias("seed"), attempt.alias("attempt"), F.greatest(attempt - PLAIN, F.lit(0)).alias("more"))
    return _let(known, lambda x: _surrogate(x["of"], x["value"], x["seed"], x["attempt"], x["more"]))


def _user(value: Column, seed: Column, more: Column) -> Column:
    """Another user of the same domain; the domain itself is replaced as a part of its own."""
    return F.concat(_letters(seed, F.substring_index(value, "@", 1)), _more(seed, more), F.lit("@"), F.substring_index(value, "@", -1))


def _domain(value: Column, seed: Column, more: Column) -> Column:
    """The top-level domain stays."""
    tail = F.substring_index(value, ".", -1)
    return F.concat(_more(seed, more, "abcdefghijklmnopqrstuvwxyz"), _letters(seed, F.substring(value, F.lit(1), F.length(value) - F.length(tail))), tail)


def _card(value: Column, seed: Column, more: Column) -> Column:
    body = F.concat(F.substring(value, 1, 1), _letters(seed, F.substring(value, F.lit(2), F.length(value) - 2)), _more(seed, more))
    return _let(body, lambda b: F.concat(b, F.pmod(_luhn(value) - _luhn(F.concat(b, F.lit("0"))) + 20, F.lit(10)).cast("string")))


def _surrogate(of: Column, value: Column, seed: Column, attempt: Column, more: Column) -> Column:
    digits = F.length(value)
    ip = F.array_join(F.transform(F.split(value, r"\."), lambda p, i: F.when(more > 0, _number(seed, i, 0, 255)).otherwise(_number(seed, i, 1, 254))), ".")
    # Leading digits of a number's parts stay away from 0 and 1; the country digit stays.
    phone = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when((i == 0) & (digits > 10), c).when((digits - i == 10) | (digits - i == 7) | (i == 0), _number(seed, i, 2, 9)).otherwise(_number(seed, i, 0, 9))), "")
    prefix = F.regexp_extract(value, rf"^{_PREFIX}", 0)
    secret = _let(value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), lambda hexadecimal: _letters(seed, value, hexadecimal=hexadecimal))
    out = F.when(of == "email", _user(value, seed, more)).when(of == "domain", _domain(value, seed, more)).when(of == "card", _card(value, seed, more)).when(of == "ip", ip)
    longer = F.when(of == "phone", phone).when(of == "ssn", _letters(seed, value)).when(of == "iban", _letters(seed, value, 2))
    longer = longer.when(of == "key", F.concat(prefix, _letters(seed, F.substring(value, F.length(prefix) + 1, F.length(value)))))
    out = out.when(of == "surname", _surname(value, seed, more)).when(of.startswith("given"), _given(of, value, seed, attempt))
    return out.otherwise(F.concat(longer.otherwise(secret), _more(seed, more)))


def formatted(of: Column, original: Column, made: Column) -> Column:
    """The canonical surrogate in the format of one occurrence."""
    step = lambda s, c: F.when(
        c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(s["out"], F.substring(made, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))
    spaced = F.aggregate(F.split(original, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), step, lambda s: F.concat(s["out"], F.substring(made, s["k"], F.length(made))))
    # E-mail addresses are written as the original: case by position where the lengths agree.
    cased = F.array_join(F.transform(F.split(made, ""), lambda c, i: F.when(F.substring(original, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    title = F.regexp_extract(original, rf"^(?:{_TITLE})\.? ", 0)
    rest = F.substring(original, F.length(title) + 1, F.length(original))
    capitals = F.array_join(F.transform(F.split(made, "-"), F.initcap), "-")
    name = F.concat(title, F.when(rest == F.upper(rest), F.upper(made)).otherwise(capitals))
    return F.when(of.isin("phone", "card", "iban", "ssn"), spaced).when(of == "email", cased).when(of.startswith("name"), name).otherwise(made)


def entities(docs: DataFrame) -> DataFrame:
    """(type, value) of every part of an entity of the corpus, each canonical value once.

    A given name that titles of different genders precede has the one gender they state, or none (``given_n``);
    ``mixed`` then says that some of its titles alone would give another type.
    """
    found = docs.where(F.col("text").rlike(HINT)).select(F.explode(F.filter(pieces(F.col("text")), lambda p, i: i % 2 == 1)).alias("entity"))
    found = found.select(F.inline(parts(F.col("entity")))).groupBy(family(F.col("type")).alias("family"), "value").agg(F.collect_set("type").alias("types"))
    stated = F.array_remove("types", "given_n")
    of = F.when(F.size("types") == 1, F.element_at("types", 1)).when(F.size(stated) == 1, F.element_at(stated, 1)).otherwise("given_n")
    return found.select(of.alias("type"), "value", (F.size("types") > 1).alias("mixed"))


def retried(found: DataFrame, key: str = KEY, make=surrogate) -> DataFrame:
    """(family, value, made) of the parts whose surrogate is not the one of their own title and first attempt.

    A surrogate is taken if another part of the family has it (the smaller value keeps it) or if it is itself
    a value of the corpus. Rounds work on the parts still without a free one; given names have rounds of their
    own, since there are few and they need more of them.
    """
    given = F.col("type").startswith("given")
    return _rounds(found.where(~given), key, make).unionByName(_rounds(found.where(given), key, make))


def _rounds(found: DataFrame, key: str, make) -> DataFrame:
    first = make(F.col("type"), F.col("value"), F.lit(0), key)
    taken = store(found.select(family(F.col("type")).alias("family"), "type", "value", "mixed", F.lit(0).alias("attempt"), first.alias("made")))
    corpus = taken.where("family <> 'given'").select("family", F.col("value").alias("made"))
    attempt = 0
    while True:
        owners = taken.groupBy("family", "made").agg(F.min(F.struct(F.col("attempt"), F.col("value"))).alias("owner"), F.count("*").alias("n"))
        clash = owners.where("n > 1").join(taken, ["family", "made"]).where(F.struct("attempt", "value") != F.col("owner"))
        columns = ["family", "type", "value", "mixed"]
        clash = store(clash.select(*columns).union(taken.join(corpus, ["family", "made"], "left_semi").select(*columns)).distinct())
        if clash.isEmpty():
            return taken.where("attempt > 0 OR mixed").select("family", "value", "made")
        attempt += 1
        again = clash.select(*columns, F.lit(attempt).alias("attempt"), make(F.col("type"), F.col("value"), F.lit(attempt), key).alias("made"))
        taken = store(taken.join(clash, ["family", "value"], "left_anti").select(*taken.columns).union(again))


def _slot(part: Column) -> Column:
    return F.concat(family(part["type"]), F.lit(":"), part["value"])


def _replaced(docs: DataFrame, key: str, make) -> DataFrame:
    """``replace`` for rows of ``text`` and ``_row``."""
    others = store(retried(store(entities(docs)), key, make))
    hinted = F.col("text").rlike(HINT)
    docs = docs.withColumn("_pieces", F.when(hinted, pieces(F.col("text"))))
    some = not others.isEmpty()
    if some:
        # Documents that hold such a part get a map of theirs, joined on the text's hash.
        holds = docs.where(hinted).select(F.xxhash64("text").alias("_h"), F.explode(F.array_distinct(F.filter("_pieces", lambda p, i: i % 2 == 1))).alias("entity"))
        holds = holds.select("_h", F.inline(parts(F.col("entity")))).select("_h", family(F.col("type")).alias("family"), "value").distinct()
        entry = F.struct(F.concat("family", F.lit(":"), "value").alias("slot"), "made")
        maps = holds.join(others, ["family", "value"]).groupBy("_h").agg(F.map_from_entries(F.collect_list(entry)).alias("_others"))
        docs = docs.withColumn("_k", F.xxhash64("text")).join(store(maps), F.col("_k") == F.col("_h"), "left").drop("_h", "_k")

    def put(piece, i):
        def one(part):
            made = make(part["type"], part["value"], F.lit(0), key)
            return F.coalesce(F.element_at("_others", _slot(part)), made) if some else made

        def whole(of, made):
            address = F.concat(F.substring_index(F.element_at(made, 1), "@", 1), F.lit("@"), F.element_at(made, -1))
            return _let(F.when(of == "email", address).otherwise(F.array_join(made, " ")), lambda m: formatted(of, piece, m))

        def named(x):
            return _let(F.transform(parts(piece), one), lambda made: whole(x["of"], made))

        return F.when(i % 2 == 1, _let(F.struct(kind(piece).alias("of")), named)).otherwise(piece)

    count = F.coalesce(F.floor(F.size("_pieces") / 2), F.lit(0))
    text = F.when(F.size("_pieces") > 1, F.replace(F.array_join(F.transform("_pieces", put), ""), F.lit(_PLAIN), F.lit(_ESCAPE))).otherwise(F.col("text"))
    return docs.select("_row", text.alias("text"), F.when(F.col("_pieces").isNull(), 0).otherwise(count).cast("long").alias("n_entities"))


def replace(docs: DataFrame, key: str = KEY, make=surrogate) -> DataFrame:
    """The documents with surrogates in ``text``, and n_entities; all columns stay."""
    return unboxed(_replaced(boxed(docs, "text"), key, make), [c for c in docs.columns if c != "n_entities"], "n_entities", text=F.col("text"))


def anonymise(docs: DataFrame) -> DataFrame:
    """``replace`` with the columns of the input; n_chars follows the text."""
    return unboxed(_replaced(boxed(docs, "text"), KEY, surrogate), docs.columns, text=F.col("text"))


def query(spark, sf_dir):
    return replace(documents(spark, sf_dir).select("doc_id", "text"))
