"""Operator 8, PII: detected entities receive keyed surrogates of their own kind.

Entities are e-mail and IP addresses, phone, card and account numbers, keys,
private-key blocks, tokens, and names behind a title (one without a gender gets a
name for any). Equal entities (by a canonical form: digits
only, or lower case) get equal surrogates everywhere; different ones never share
a surrogate: collisions are looked for in the table of distinct entities and
hashed again until there are none. A surrogate keeps the format of each
occurrence (separators, case, length, country code, issuer digit and check digit
of a card, prefix of a key), and a name the gender of its title and its script.
DataFrame functions only; surrogates are keyed SHA-256, so without the key they
can't be traced back.

The texts are searched once and written with what was found; only texts that hold
an entity move. Where a format has too few members for its entities, surrogates
grow by some characters. Defined results: null texts count as empty
and hold nothing; repeated rows get equal results; a null id is an id like others;
an empty table gives no rows; very long texts are searched whole; ties do not
matter; result columns replace columns of the same name, others of any name stay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, settled, text_of, wide_hash

#: From this draw on surrogates grow: most formats never get there.
GROW_AFTER = 4

#: Titles by gender and script, and names to choose from.
TITLES = {
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Mme", "Frau", "Sra"],
    ("m", "latin"): ["Mr", "Herr", "Monsieur", "Sr"],
    ("n", "latin"): ["Dr", "Prof"],
    ("f", "cyrillic"): ["Госпожа", "госпожа"],
    ("m", "cyrillic"): ["Господин", "господин"],
}
FIRST_NAMES = {
    ("f", "latin"): ["Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera", "Zoe"],
    ("m", "latin"): ["Adam", "Bruno", "David", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Marco", "Oscar", "Paul", "Viktor"],
    ("n", "latin"): ["Alex", "Chris", "Kim", "Luca", "Noa", "Robin", "Sam", "Toni"],
    ("f", "cyrillic"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Иван", "Лев", "Олег", "Павел", "Роман"],
}
SYLLABLES = {"latin": ["bar", "den", "fel", "gor", "hal", "kin", "lor", "mar", "nel", "per", "ros", "sten", "tor", "ven", "wil", "zan"],
             "cyrillic": ["бар", "вол", "гор", "дар", "зор", "кал", "лав", "мир", "нов", "пет", "род", "сам", "тар", "фед", "чер", "шум"]}

_NAME = {"latin": r"\p{Lu}[\p{L}'’-]+", "cyrillic": r"\p{Lu}\p{L}+"}
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
#: One pattern per kind; the first that fits an occurrence names it.
PATTERNS: dict[str, str] = {
    "block": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,20}PRIVATE KEY-----",
    "email": r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{8,15}(?!\d)"
             r"|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,8}){2,5}(?!\d)|(?<![\w+.,-])0\d{2,4}[ /-]\d{5,8}(?![\d.,])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w])",
    "account": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?!\w)",
    "key": r"(?<!\w)(?:AKIA[A-Z0-9]{16}|(?:ghp_|sk-)[A-Za-z0-9]{16,64}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,72})(?!\w)"
           r"|(?<!\w)eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "token": r"(?<!\w)[0-9A-Fa-f]{32,128}(?!\w)",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME['latin']}(?: {_NAME['latin']})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every entity passes.
HINT = rf"[0-9@]|AKIA|ghp_|sk-|AIza|xox|eyJ|-----BEGIN |[A-Fa-f]{{32}}|{_TITLE}"


def kind_of(found: Column) -> Column:
    """The kind of an occurrence that ANY matched (anchored patterns, in order)."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(found.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def canonical(kind: Column, found: Column) -> Column:
    """What makes two occurrences the same entity."""
    return (F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(found, r"\D", ""))
            .when(kind.isin("account"), F.regexp_replace(found, " ", ""))
            .when(kind.isin("email", "token"), F.lower(found))
            .when(kind == "name", F.regexp_replace(found, r"\.", ""))
            .otherwise(found))


def _draw(secret: str, seed: Column, place: Column, modulus) -> Column:
    """A number below modulus from the keyed hash of (entity, place)."""
    digest = F.sha2(F.concat(F.lit(secret), F.lit("\x1f"), seed, F.lit("\x1f"), (place / 8).cast("int").cast("string")), 256)
    return F.conv(F.substring(digest, place % 8 * 8 + 1, F.lit(8)), 16, 10).cast("long") % modulus


def _pick(values: str | list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def _char(c: Column, draw: Column, hexadecimal: Column) -> Column:
    """A character of the same kind: digit, upper or lower case letter, or c itself.
    Letters outside ASCII become lower case ones of their script, or Latin ones."""
    return (F.when(hexadecimal, F.substring(F.lit("0123456789abcdef"), (draw % 16 + 1).cast("int"), F.lit(1)))
            .when(c.rlike("^[0-9]$"), (draw % 10).cast("string"))
            .when(c.rlike("^[a-z]$"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (draw % 26 + 1).cast("int"), F.lit(1)))
            .when(c.rlike("^[A-Z]$"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (draw % 26 + 1).cast("int"), F.lit(1)))
            .when(c.rlike(r"^[\x00-\x7F]$"), c)
            .when(c.rlike(r"^\p{IsCyrillic}$"), F.substring(F.lit("абвгдежзиклмнопрстуфхцчшщэюя"), (draw % 28 + 1).cast("int"), F.lit(1)))
            .when(c.rlike(r"^\p{L}$"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (draw % 26 + 1).cast("int"), F.lit(1)))
            .otherwise(c))


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _luhn(digits: Column) -> Column:
    """digits with the last one set so that the card's check sum holds."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0).cast("int"), lambda s, i: s + F.when(
        (n - i) % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)
    ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    return F.concat(F.substring(digits, F.lit(1), n - 1), ((10 - total % 10) % 10).cast("string"))


def surrogate(kind: Column, canon: Column, attempt: Column, secret: str) -> Column:
    """The replacement of an entity in its canonical form."""
    seed = F.concat_ws("\x1f", kind, canon, attempt.cast("string"))
    # how many leading characters stay: country code, issuer digit, prefix of a key
    kept = (F.when(kind == "phone", F.greatest(F.length(canon) - 10, F.lit(0))).when(kind == "card", 1).when(kind == "account", 2)
            .when(canon.rlike("^(?:AKIA|ghp_|AIza)"), 4).when(canon.startswith("xox"), 5).when(kind == "key", 3)
            .when(kind == "block", F.locate("-----", canon, 6) + 4).otherwise(0))
    domain = F.locate(".", F.reverse(canon))  # the last label of an address stays
    tail = F.length(canon) - F.locate("DNE-----", F.reverse(canon)) - 7  # the closing line of a key block stays
    same = F.concat_ws("", F.transform(_chars(canon), lambda c, i: F.when(
        (i < kept) | ((kind == "email") & (i > F.length(canon) - domain)) | ((kind == "block") & (i >= tail)), c).otherwise(
            _char(c, _draw(secret, seed, i, 10 ** 9), kind == "token"))))
    # a format with few members: characters are added in front of an address or key, digits behind a number
    more = F.transform(F.sequence(F.lit(1), attempt - GROW_AFTER + 1), lambda i: _char(
        F.when(kind.isin("phone", "card", "ssn", "account", "ip"), "0").otherwise("a"), _draw(secret, seed, 1000 + i, 10 ** 9), F.lit(False)))
    more = F.when(attempt >= GROW_AFTER, F.concat_ws("", more)).otherwise("")
    same = F.when(kind.isin("phone", "card", "ssn", "account"), F.concat(same, more)).otherwise(F.concat(more, same))
    octets = F.concat_ws(".", F.transform(F.split(canon, r"\."), lambda c, i: (_draw(secret, seed, i, 254) + 1).cast("string")))
    name = F.lit(None).cast("string")
    for (gender, script), titles in TITLES.items():
        words = F.split(canon, " ")
        first = _pick(FIRST_NAMES[gender, script], _draw(secret, seed, F.lit(0), len(FIRST_NAMES[gender, script])))
        syllables = SYLLABLES[script]
        last = F.initcap(F.concat_ws("", F.transform(
            F.sequence(F.lit(1), attempt + 3), lambda i: _pick(syllables, _draw(secret, seed, i, 16)))))
        made = F.when(F.size(words) > 2, F.concat_ws(" ", words[0], first, last)).otherwise(F.concat_ws(" ", words[0], last))
        name = F.when(F.split(canon, " ")[0].isin(titles), made).otherwise(name)
    octets = F.concat(octets, more)
    return (F.when(kind == "ip", octets).when(kind == "card", _luhn(same)).when(kind == "name", F.coalesce(name, canon)).otherwise(same))


def rendered(kind: Column, found: Column, replacement: Column) -> Column:
    """The replacement in the format of one occurrence."""
    digits = F.concat_ws("", F.transform(_chars(found), lambda c, i: F.when(
        c.rlike(r"^\d$"), F.substring(replacement, F.length(F.regexp_replace(F.substring(found, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)))
    spaced = F.concat_ws("", F.transform(_chars(found), lambda c, i: F.when(
        c != " ", F.substring(replacement, F.length(F.regexp_replace(F.substring(found, F.lit(1), i + 1), " ", "")), F.lit(1))).otherwise(c)))
    cased = F.concat_ws("", F.transform(_chars(found), lambda c, i: F.when(
        c.rlike(r"^\p{Lu}$"), F.upper(F.substring(replacement, i + 1, F.lit(1)))).otherwise(F.substring(replacement, i + 1, F.lit(1)))))
    # a surrogate that had to grow
    digits = F.concat(digits, F.substring(replacement, F.length(F.regexp_replace(found, r"\D", "")) + 1, F.lit(64)))
    spaced = F.concat(spaced, F.substring(replacement, F.length(F.regexp_replace(found, " ", "")) + 1, F.lit(64)))
    cased = F.when(F.length(replacement) == F.length(found), cased).otherwise(replacement)
    dotted = F.regexp_replace(replacement, r"^(\p{L}+) ", "$1. ")
    return (F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "account", spaced).when(kind == "email", cased)
            .when((kind == "token") & found.rlike("^[0-9A-F]*[A-F][0-9A-F]*$"), F.upper(replacement)).when(kind == "token", cased)
            .when((kind == "name") & found.rlike(r"^\p{L}+\. "), dotted).otherwise(replacement))


def distinct_surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """(kind, canon, surrogate) with no surrogate given twice, nor to an entity itself.

    Of entities that share a surrogate the first keeps it and the others are
    hashed again; only whether there are any reaches the driver. Where a format has
    too few surrogates for its entities, later draws get longer, so this ends.
    """
    now = settled(entities.select("kind", "canon", F.lit(0).alias("attempt"))
                  .withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), secret)))
    while True:
        holders = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("keeper"), F.count("*").alias("n"))
        shared = holders.filter("n > 1").select("kind", "surrogate", "keeper.canon").withColumnRenamed("canon", "keeper")
        known = now.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("is_entity"))
        marked = (now.join(shared, ["kind", "surrogate"], "left").join(known, ["kind", "surrogate"], "left")
                  .withColumn("again", F.coalesce(F.col("keeper") != F.col("canon"), F.lit(False)) | F.col("is_entity").isNotNull()))
        if marked.filter("again").isEmpty():
            return now.select("kind", "canon", "surrogate")
        attempt = F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        now = settled(marked.select("kind", "canon", attempt.alias("attempt"), "again", "surrogate").select(
            "kind", "canon", "attempt",
            F.when(F.col("again"), surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), secret)).otherwise(F.col("surrogate")).alias("surrogate")))


def replace_entities(docs: DataFrame, text_col: str = "text", secret: str = "surrogates") -> DataFrame:
    """docs with the text's entities replaced, and n_entities and entity_kinds."""
    text = text_of(text_col)
    keep = [c for c in docs.columns if c not in ("n_entities", "entity_kinds", text_col)]
    # what the caller gave stays in one struct, away from the names used here
    given = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("int")
    base = docs.select(given.alias("_given"), text.alias("_text"))
    held = F.when(F.col("_text").rlike(HINT), F.regexp_extract_all("_text", F.lit(ANY), F.lit(0)))
    # the texts are searched once; what is found is written beside them
    found = base.withColumn("_found", F.coalesce(held, F.array().cast("array<string>")))
    path = f"{ensure_checkpoint_dir(docs.sparkSession).rstrip('/')}/pii-{uuid.uuid4().hex}"
    found.write.parquet(path)
    base = docs.sparkSession.read.schema(found.schema).parquet(path)
    some = base.filter(F.size("_found") > 0).withColumns({f"_row{i}": h for i, h in enumerate(wide_hash(F.col("_text")))})
    places = (some.select("_row0", "_row1", F.posexplode("_found").alias("_pos", "_occurrence"))
              .withColumn("kind", F.coalesce(kind_of(F.col("_occurrence")), F.lit("token"))))
    places = places.withColumn("canon", canonical(F.col("kind"), F.col("_occurrence")))
    mapping = distinct_surrogates(places.select("kind", "canon").distinct(), secret)
    made = places.join(mapping, ["kind", "canon"]).select(
        "_row0", "_row1", F.struct(F.col("_pos").alias("pos"), rendered(F.col("kind"), F.col("_occurrence"), F.col("surrogate")).alias("text"), "kind").alias("one"))
    per_text = made.groupBy("_row0", "_row1").agg(F.sort_array(F.collect_set("one")).alias("_new"))
    parts = F.split("_text", ANY, -1)
    joined = F.concat_ws("", F.transform(F.col("_parts"), lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_new"), i)["text"], F.lit("")))))
    changed = some.join(per_text, ["_row0", "_row1"]).withColumn("_parts", parts).select(
        "_given", joined.alias("_made"), F.size("_new").cast("long").alias("_n"),
        F.array_sort(F.array_distinct(F.transform("_new", lambda x: x["kind"]))).alias("_kinds"))
    same = base.filter(F.size("_found") == 0).select(
        "_given", F.col("_text").alias("_made"), F.lit(0).cast("long").alias("_n"), F.array().cast("array<string>").alias("_kinds"))
    return same.unionByName(changed).select(*[F.col(f"_given.`{c}`") for c in keep], F.col("_made").alias(text_col), F.col("_n").alias("n_entities"),
                                            F.col("_kinds").alias("entity_kinds"))


def surrogate_report(docs: DataFrame) -> DataFrame:
    return replace_entities(docs.select("doc_id", "text"))
