"""PII surrogates.

Detected entities (e-mail and IPv4 addresses, phone, card and social security numbers, names
after a form of address) are replaced by made-up ones of the same type and format: digits for
digits, letters for letters of the same case, octets for octets, a card number that passes or
fails its checksum as the original does, each word of a name by a name of the gender its form
of address tells (male where it tells none) and of the same script. A surrogate is a keyed hash of (type, entity), so all mentions of an
entity get the same one in every document, and without the key nothing leads back.

Distinct entities must stay distinct. All distinct entities of the corpus are checked: where
surrogates clash with each other or with a real entity, all but one of the clashing ones are
drawn again under the next salt, until none clashes; where a format is too short for all its
entities, the last ones get longer surrogates. Only entities move for this, added up on the map
side; texts with entities move once, to meet their surrogates.

Everything is built from DataFrame functions.

Defined cases: a null text stays null and has no entities; texts without entities are
unchanged; null ids and repeated rows are answered each; an empty table gives an empty result;
other columns pass through ``pseudonymize``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.common import ROW, boxed, saved, table, unboxed

KEY = "surrogate-key-1"
ROUNDS = 8

# Patterns of the entity types, in order of precedence.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ADDRESS = (
    "Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|Госпожа"
    "|Dr|Prof|Professor|Доктор|Профессор"
)
# A word of a name: letters, also after an apostrophe (not that of a possessive) or a hyphen.
_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:(?:['’](?!s(?!\p{L}))|-)[\p{L}\p{M}]++){0,8}+"
# Capitals with full stops before more of the name, or a capital alone before another word.
_INITIAL = r"(?:\p{Lu}\.){1,4}(?= ?\p{Lu})|\p{Lu}(?= \p{Lu})"
_PARTICLE = "(?:(?:van|von|der|den|de|del|della|da|di|du|la|le|al|bin|ibn|zu|zur|ter|dos|das) ){0,3}"
_TITLE = rf"(?:(?:{_ADDRESS})\.? )"
_MORE = rf"(?: {_PARTICLE}|(?<=\.))(?!(?:{_ADDRESS})(?!\p{{L}}))(?:{_INITIAL}|(?=\p{{Lu}}[\p{{L}}'’-]){_WORD})"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])(?!\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{13,19})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name": rf"(?<![\p{{L}}]){_TITLE}{{1,4}}{_PARTICLE}(?:{_INITIAL}|{_WORD})(?:{_MORE}){{0,8}}+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# A cheap test that every text with an entity passes.
HINT = rf"[0-9@]|{_TITLE}{_PARTICLE}\p{{Lu}}"
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа)"
# Names to draw from, by script and gender.
NAMES = {
    ("latin", "f"): ["Anna", "Clara", "Elena", "Greta", "Irene", "Julia", "Laura", "Maria", "Nina", "Paula"],
    ("latin", "m"): ["Albert", "Bruno", "Carlos", "David", "Emil", "Felix", "Hugo", "Leon", "Martin", "Oscar"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Роман"],
}


def entities(text: Column) -> Column:
    """All entities of a text in order; an empty array where there are none."""
    none = F.array().cast("array<string>")
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    return F.coalesce(found, none)


def entity_type(entity: Column) -> Column:
    kind = F.lit("name")
    for name in reversed(list(PATTERNS)[:-1]):
        kind = F.when(entity.rlike(rf"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    return kind


def _draw(stream: Column, i: Column, below: int) -> Column:
    """The i-th number below ``below`` of a stream of hexadecimal digits."""
    return F.conv(F.substring(F.concat(stream, stream), (i * 3) % 125 + 1, 3), 16, 10).cast("int") % below


def _formatted(entity: Column, stream: Column, fixed: Column | None = None) -> Column:
    """Digits for digits and letters for letters; ``fixed`` leading characters stay."""
    chars = F.split(entity, "")

    def one(c: Column, i: Column) -> Column:
        digit = _draw(stream, i, 10).cast("string")
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(stream, i, 26) + 1, 1)
        # The first digit of a group is never made a zero that was none.
        shown = (
            F.when(c.rlike("[1-9]"), F.when(digit == "0", "7").otherwise(digit))
            .when(c == "0", digit)
            .when(c.rlike(r"^\p{Lu}"), F.upper(letter))
            .when(c.rlike(r"^\p{L}"), letter)
            .otherwise(c)
        )
        return shown if fixed is None else F.when(i < fixed, c).otherwise(shown)

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the card checksum; a valid number gives 0 modulo 10."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(
        values, lambda d, i: F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _card(entity: Column, drawn: Column) -> Column:
    """``drawn`` with its last digit set so that it passes the checksum if ``entity`` does."""
    valid = _luhn(F.regexp_replace(entity, "[ -]", "")) % 10 == 0
    body = F.expr("substr(drawn, 1, length(drawn) - 1)")
    rest = _luhn(F.concat(F.regexp_replace(body, "[ -]", ""), F.lit("0"))) % 10
    right = (10 - rest) % 10
    last = F.col("last_draw") % 9
    wrong = F.when(last >= right, last + 1).otherwise(last)
    return F.concat(body, F.when(valid, right).otherwise(wrong).cast("string"))


def _name(entity: Column, key: str) -> Column:
    """Every word replaced by its own surrogate, so that a surname stays the same with and
    without a first name. Only the first words of several are drawn again under a salt."""
    address = F.regexp_extract(entity, rf"^({_TITLE}+)", 1)
    rest = F.substring(entity, F.length(address) + 1, F.length(entity))
    cyrillic = entity.rlike(r"[\p{IsCyrillic}]$")
    female = entity.rlike(FEMALE)

    def pick(stream: Column, script: str, gender: str) -> Column:
        pool = NAMES[(script, gender)]
        first = F.element_at(F.lit(pool), _draw(stream, F.lit(1), len(pool)) + 1)
        # A made-up ending keeps distinct names distinct in a pool this small.
        letters = "abcdefghijklmnopqrstuvwxyz" if script == "latin" else "абвгдежзиклмнопрст"
        tail = [
            F.substring(F.lit(letters), _draw(stream, F.lit(k), len(letters)) + 1, 1)
            for k in (7, 11, 13, 17, 19, 23)
        ]
        return F.concat(first, *tail)

    def shown(word: Column, stream: Column) -> Column:
        latin = F.when(female, pick(stream, "latin", "f")).otherwise(pick(stream, "latin", "m"))
        slavic = F.when(female, pick(stream, "cyrillic", "f")).otherwise(pick(stream, "cyrillic", "m"))
        drawn = F.when(cyrillic, slavic).otherwise(latin)
        return F.when(F.length(word) == 1, F.substring(drawn, 1, 1)).otherwise(drawn)

    words = F.regexp_extract_all(rest, F.lit(_WORD), F.lit(0))
    salt = F.col("salt").cast("string")
    streams = F.transform(
        words,
        lambda w, i: F.sha2(
            F.concat_ws(
                ":",
                F.lit(key),
                F.lit("name"),
                F.when((i > 0) & (i == F.size(words) - 1), "0").otherwise(salt),
                F.lower(w),
            ),
            512,
        ),
    )
    gaps = F.split(rest, _WORD, -1)
    pairs = F.zip_with(
        gaps, F.zip_with(words, streams, shown), lambda g, x: F.array(g, F.coalesce(x, F.lit("")))
    )
    return F.concat(address, F.array_join(F.flatten(pairs), ""))


def draw_surrogates(found: DataFrame, key: str = KEY) -> DataFrame:
    """``found`` (kind, entity, salt) with a column ``surrogate``."""
    seed = F.concat_ws(":", F.lit(key), "kind", F.col("salt").cast("string"), F.lower("entity"))
    frame = found.withColumn("stream", F.sha2(seed, 512))
    entity, stream = F.col("entity"), F.col("stream")
    prefix = F.length(F.regexp_extract(entity, r"^(\+[0-9]{1,3})(?=[ .(-])", 1))
    frame = frame.withColumn(
        "drawn", _formatted(entity, stream, F.when(F.col("kind") == "phone", prefix).otherwise(0))
    ).withColumn("last_draw", _draw(stream, F.lit(41), 9))
    octets = F.array_join(
        F.transform(
            F.split(entity, r"\."), lambda o, i: (_draw(stream, i, 223) + 1).cast("string")
        ),
        ".",
    )
    # The last label of the domain becomes the one reserved for examples.
    local = F.expr("substr(drawn, 1, instr(drawn, '@'))")
    domain = F.regexp_replace(F.expr("substr(drawn, instr(drawn, '@') + 1)"), r"\.[^.@]+$", "")
    ending = F.when(F.expr("entity = upper(entity)"), ".EXAMPLE").otherwise(".example")
    mail = F.concat(local, domain, ending)
    surrogate = (
        F.when(F.col("kind") == "ipv4", octets)
        .when(F.col("kind") == "card", _card(entity, F.col("drawn")))
        .when(F.col("kind") == "email", mail)
        .when(F.col("kind") == "name", _name(entity, key))
        .otherwise(F.col("drawn"))
    )
    return frame.withColumn("surrogate", surrogate).drop("stream", "drawn", "last_draw")


def surrogate_map(distinct: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, entity, surrogate, salt) for distinct (kind, entity), free of clashes."""
    fresh = distinct.withColumn("salt", F.lit(0))
    settled = None
    for _ in range(ROUNDS):
        drawn = draw_surrogates(fresh, key)
        known = drawn if settled is None else settled.unionByName(drawn)
        # Settled ones keep their surrogate: of a clash the lowest salt comes first.
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("salt", "entity"))
        real = distinct.select(F.col("kind").alias("r_kind"), F.col("entity").alias("surrogate"))
        ranked = known.withColumn("rank", rank).join(real, "surrogate", "left")
        settled = saved(
            ranked.withColumn(
                "clash", (F.col("rank") > 1) | F.col("r_kind").isNotNull()
            ).drop("rank", "r_kind")
        )
        clashing = settled.where("clash")
        if clashing.isEmpty():
            return settled.drop("clash")
        fresh = clashing.select("kind", "entity", (F.col("salt") + 1).alias("salt"))
        settled = settled.where("NOT clash").drop("clash")
    # A format too short for all its entities: the last ones get longer surrogates.
    seed = F.sha2(F.concat_ws(":", F.lit(key), "kind", "entity"), 256)
    more = F.substring(seed, 1, 12)
    digits = F.conv(more, 16, 10)
    longer = F.when(F.col("kind").isin("email", "name"), F.concat(more, "surrogate")).otherwise(
        F.concat("surrogate", digits)
    )
    last = draw_surrogates(fresh, key).withColumn("surrogate", longer)
    return settled.unionByName(last)


def _text_key():
    """A text is named by its length and two hashes."""
    text = F.col("text")
    return F.struct(F.length(text).alias("size"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b"))


def pseudonymize(docs: DataFrame, key: str = KEY) -> tuple[DataFrame, DataFrame]:
    """(documents with ``text`` replaced and ``n_entities``, the surrogate map)."""
    names, docs = docs.columns, boxed(docs, "text")
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    # Only texts that may hold an entity are moved; all others pass as they are.
    tagged = docs.where(hinted).withColumn("own_key", _text_key())
    with_entities = docs.select("text").where(hinted)
    texts = saved(
        with_entities.select(_text_key().alias("text_key"), entities(F.col("text")).alias("found"))
        .where(F.size("found") > 0)
        .groupBy("text_key")
        .agg(F.first("found").alias("found"))
    )
    mentions = texts.select("text_key", F.posexplode("found").alias("at", "entity"))
    distinct = saved(
        mentions.select("entity").distinct().withColumn("kind", entity_type(F.col("entity")))
    )
    mapped = surrogate_map(distinct.select("kind", "entity"), key)
    by_text = (
        mentions.join(mapped.select("entity", "surrogate"), "entity")
        .groupBy("text_key")
        .agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("found"))
        .select("text_key", F.col("found.surrogate").alias("surrogates"))
    )
    joined = tagged.join(by_text, F.col("own_key") == F.col("text_key"), "left")
    gaps = F.split("text", ANY, -1)
    pairs = F.zip_with(gaps, "surrogates", lambda g, x: F.array(g, F.coalesce(x, F.lit(""))))
    merged = F.array_join(F.flatten(pairs), "")
    changed = joined.select(
        F.when(F.col("surrogates").isNotNull(), merged).otherwise(F.col("text")).alias("text"),
        ROW,
        F.coalesce(F.size("surrogates"), F.lit(0)).cast("long").alias("n_entities"),
    )
    same = docs.where(~hinted).select("text", ROW, F.lit(0).cast("long").alias("n_entities"))
    kept = [c for c in names if c.lower() != "n_entities"]
    own = [F.col("text").alias(c) if c == "text" else column for c, column in zip(kept, unboxed(kept), strict=True)]
    return same.union(changed).select(*own, "n_entities"), mapped


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs)[0]
