"""Personal data replaced by keyed surrogates of the same type, gender, script and format; DataFrame functions only."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import HOT, spread_join
from gaugeline.session import checkpointed

#: A name word: inner and all capitals, hyphens, apostrophes; initials may stand before it.
_NAME = r"(?:\p{Lu}\. ?)*\p{Lu}['’]?[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+|['’]\p{Lu}[\p{L}\p{M}]+)*"
#: Titles by the gender they tell.
TITLES = {
    "f": "Mrs Ms Miss Frau Señora Madame Mme Dra Госпожа".split(),
    "m": "Mr Herr Señor Monsieur Sir Господин".split(),
    "n": "Dr Prof".split(),
}
_TITLE = f"(?:{'|'.join(t for known in TITLES.values() for t in known)})"
#: What is looked for, the first pattern that fits naming the type of a mention. \\b and classes are ASCII unless said.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)|(?<!\d)\d{13,19}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
    "phone": r"\+\d{1,3}[^\p{L}\p{N}\n]{0,6}\(?\d{2,4}\)?(?:[^\p{L}\p{N}\n]{1,6}\d{2,4}){1,4}|\+\d{8,15}(?!\d)"
    r"|\(\d{3}\)[^\p{L}\p{N}\n]{0,6}\d{3}[^\p{L}\p{N}\n]{1,3}\d{4}(?!\d)|(?<![\d-])(?:\d{3}[.-])?\d{3}[.-]\d{4}(?![\d-])",
    "person": rf"(?<!\p{{L}})(?:{_TITLE}\.? )+{_NAME}(?: {_NAME})*",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without this cannot hold a mention: spares most texts the long pattern.
HINT = rf"[0-9@]|sk-|gh[pousr]_|AKIA|[a-f]{{32}}|[A-F]{{32}}|{_TITLE}\.? "
FEMALE, MALE = (rf"^(?:{_TITLE}\.? )*?(?:{'|'.join(TITLES[g])})\.? " for g in "fm")
TITLE = rf"^(?:{_TITLE}\.? )+"
#: What stays of a secret: it tells the kind, not the owner.
PREFIX = "^(AKIA|gh[pousr]_|sk-)"
#: So many draws keep the format of an entity; where they find nothing free, its values are nearly used up and each further one is longer by a sign.
DRAWS = 40
#: First names by gender and parts of family names, for Latin and Cyrillic script.
NAMES = {
    ("latin", "f"): "Anna Clara Elena Flora Greta Irene Julia Laura Maria Nina Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivo Jonas Leon Marco Oscar Paul Simon Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Лидия Мария Нина Ольга Полина Раиса София Тамара Ульяна Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Юрий".split(),
}
PARTS = {"latin": "bar den for gal hol kan lin mar nor pel ran sel tor val wen zim".split(), "cyrillic": "бар ден фор гал хол кан лин мар нор пел ран сел тор вал вен зим".split()}
#: Places that the row of a hot list is copied to.
SALT = 64
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
WIDER = ["àâçéèêëîïôùûüäöñáíóúß", "ÀÂÇÉÈÊËÎÏÔÙÛÜÄÖÑÁÍÓÚ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]


def _byte(digest: Column, k: Column) -> Column:
    """The k-th number below 65536 from a hexadecimal digest of 128 signs, starting over at its end."""
    return F.conv(F.substring(digest, (F.pmod(k, F.lit(32)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _signs(text: Column, digest: Column, alphabets: list[str]) -> Column:
    """The text with each sign of an alphabet replaced by another of the same one; other signs stay."""

    def sign(c: Column, k: Column) -> Column:
        n = _byte(digest, k)
        out = c
        for signs in reversed(alphabets):
            out = F.when(F.lit(signs).contains(c) & (c != ""), F.substring(F.lit(signs), (n % len(signs) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), sign), "")


def kind_of(mention: Column) -> Column:
    cases = F.lit("person")
    for name, pattern in reversed(list(PATTERNS.items())):
        cases = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(cases)
    return cases


def canonical(mention: Column, kind: Column) -> Column:
    """What the spellings of one entity share: its digits, its small letters, or a name (in any case) with the gender of its title."""
    digits = F.regexp_replace(mention, r"\D", "")
    person = F.concat(F.when(mention.rlike(FEMALE), "f ").when(mention.rlike(MALE), "m ").otherwise("n "), F.initcap(F.regexp_replace(mention, TITLE, "")))
    secret = F.when(mention.rlike(PREFIX), mention).otherwise(F.lower(mention))
    cases = F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "person", person).when(kind == "iban", F.regexp_replace(mention, " ", ""))
    return cases.when(kind == "secret", secret).otherwise(F.lower(mention))


def luhn(digits: Column) -> Column:
    """The sum of a card number by Luhn's rule, as if a check digit of 0 followed."""
    doubled = F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))

    def value(c: Column, k: Column) -> Column:
        digit = c.cast("int")
        return F.when(k % 2 == 0, F.get(doubled, digit)).otherwise(digit)

    signs = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    return F.aggregate(F.transform(signs, value), F.lit(0), lambda a, x: a + x)


def mod97(iban: Column) -> Column:
    """The remainder of an IBAN by 97, its first four signs at the end and letters as 10 to 35: 1 where it is valid."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.regexp_extract_all(turned, F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), step)


def _all_but_last(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - 1)


def _last(text: Column) -> Column:
    return F.substring(text, -1, 1)


def _checked_card(entity: Column, drawn: Column) -> Column:
    """The drawn number with a valid check digit if the entity has one."""
    valid = (luhn(_all_but_last(entity)) + _last(entity).cast("int")) % 10 == 0
    return F.when(valid, F.concat(_all_but_last(drawn), ((10 - luhn(_all_but_last(drawn)) % 10) % 10).cast("string"))).otherwise(drawn)


def _checked_iban(entity: Column, drawn: Column) -> Column:
    """The drawn IBAN with valid check digits if the entity has them."""
    country, rest = F.substring(drawn, 1, 2), F.substring(drawn, F.lit(5), F.length(drawn))
    digits = F.lpad((98 - mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    return F.when(mod97(entity) == 1, F.concat(country, digits, rest)).otherwise(drawn)


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The ``attempt``-th surrogate of an entity, in its canonical form. After ``DRAWS`` it grows."""
    more = F.greatest(attempt - (DRAWS - 1), F.lit(0))
    zeros, letters = F.repeat(F.lit("0"), more), F.repeat(F.lit("a"), more)
    digest = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, entity, attempt.cast("string")).cast("binary"), 512)
    plain, every = ALPHABETS, ALPHABETS + WIDER
    domain = F.regexp_extract(entity, "@(.*)$", 1)
    host, top = F.regexp_replace(domain, r"\.[^.]*$", ""), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    of_host = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("host"), host).cast("binary"), 512)  # one host, one surrogate
    email = F.concat(_signs(F.concat(F.regexp_extract(entity, "^([^@]*)@", 1), letters), digest, every), F.lit("@"), _signs(host, of_host, every), top)
    ip = F.concat_ws(".", *(((_byte(digest, F.lit(k)) % 254) + 1).cast("string") for k in range(4)))
    ip = F.concat(ip, F.array_join(F.transform(F.sequence(F.lit(0), more), lambda k: F.when(k > 0, F.concat(F.lit("."), (_byte(digest, k + 3) % 254 + 1).cast("string"))).otherwise("")), ""))
    # The country code and the first digit of a card stay: they are the format, not the person.
    keep = F.when(kind == "card", 1).when((kind == "phone") & (F.length(entity) > 10), F.length(entity) - 10).otherwise(0)
    digits = F.concat(F.substring(entity, F.lit(1), keep), _signs(F.concat(F.substring(entity, keep + 1, F.length(entity)), zeros), digest, plain[:1]))
    hexadecimal = entity.rlike("^[0-9a-f]{32,64}$")
    prefix = F.regexp_extract(entity, PREFIX, 1)
    signs = F.concat(prefix, _signs(F.concat(F.substring(entity, F.length(prefix) + 1, F.length(entity)), zeros), digest, plain))
    secret = F.when(hexadecimal, F.substring(digest, F.lit(1), F.length(entity) + more)).otherwise(signs)
    iban = F.concat(F.substring(entity, 1, 2), _signs(F.concat(F.substring(entity, F.lit(3), F.length(entity)), zeros), digest, [plain[0], plain[2]]))

    def pick(values: list[str], k: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (_byte(digest, F.lit(k)) % len(values) + 1).cast("int"))

    def name(script: str) -> Column:
        first = F.when(entity.startswith("f "), pick(NAMES[script, "f"], 0)).when(entity.startswith("m "), pick(NAMES[script, "m"], 0)).otherwise(pick(NAMES[script, "f"] + NAMES[script, "m"], 0))
        # More parts with every attempt, so that names never run out.
        parts = F.transform(F.sequence(F.lit(1), attempt + 3), lambda k: F.element_at(F.array(*map(F.lit, PARTS[script])), (_byte(digest, k) % 16 + 1).cast("int")))
        last = F.initcap(F.array_join(parts, ""))
        return F.concat(F.substring(entity, 1, 2), F.when(F.substring(entity, F.lit(3), F.length(entity)).contains(" "), F.concat(first, F.lit(" "), last)).otherwise(last))

    person = F.when(entity.rlike("[А-Яа-яЁё]"), name("cyrillic")).otherwise(name("latin"))
    cases = {"email": email, "ip": ip, "card": _checked_card(entity, digits), "ssn": digits, "phone": digits, "secret": secret, "iban": _checked_iban(entity, iban)}
    return reduce(lambda rest, k: F.when(kind == k, cases[k]).otherwise(rest), cases, person)


def surname(name: Column) -> Column:
    """The last word of a person in canonical form."""
    return F.element_at(F.split(name, " "), -1)


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, entity, surrogate), distinct surrogates for distinct entities, none of them an entity that occurs. Of persons the
    surname alone is distinct, since it may stand alone.

    All entities draw; of those that drew the same, or what an earlier one has, or a real entity, one at most keeps it
    and the others draw again. Each round is an aggregate and two anti joins, whatever the number of entities. Draws after
    ``DRAWS`` are longer each time, so the rounds end even where a format has no value left.
    """
    entities = checkpointed(entities.select("kind", "entity").distinct())

    def taken(of: Column) -> Column:
        return F.when(F.col("kind") == "person", F.lower(surname(of))).otherwise(of)

    real = entities.select("kind", taken(F.col("entity")).alias("taken")).distinct()
    open_, done = entities, None
    for attempt in itertools.count():
        drawn = open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), F.lit(attempt), key))
        drawn = drawn.withColumn("taken", taken(F.col("surrogate"))).join(real, ["kind", "taken"], "left_anti")
        if done is not None:
            drawn = drawn.join(done.select("kind", "taken"), ["kind", "taken"], "left_anti")
        fresh = drawn.groupBy("kind", "taken").agg(F.min(F.struct("entity", "surrogate")).alias("s")).select("kind", "s.entity", "s.surrogate", "taken")
        done = checkpointed(fresh if done is None else done.unionByName(fresh))
        open_ = checkpointed(entities.join(done, ["kind", "entity"], "left_anti"))
        if open_.isEmpty():
            return done.drop("taken")


def formatted(mention: Column, kind: Column, surrogate_: Column) -> Column:
    """The surrogate in the format of a mention: its separators, its case, its title."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def fill(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(surrogate_, s["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, s["k"] + 1).otherwise(s["k"]).alias("k"))

    def finish(s: Column) -> Column:  # with what a longer surrogate has left
        return F.concat(s["out"], F.substring(surrogate_, s["k"], F.length(surrogate_)))

    digits = F.aggregate(F.split(mention, ""), start, fill, finish)
    iban_start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def fill_all(s: Column, c: Column) -> Column:
        return F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substring(surrogate_, s["k"], F.lit(1)))).alias("out"), F.when(c == " ", s["k"]).otherwise(s["k"] + 1).alias("k"))

    iban = F.aggregate(F.split(mention, ""), iban_start, fill_all, finish)
    name, new = F.regexp_replace(mention, TITLE, ""), F.substring(surrogate_, F.lit(3), F.length(surrogate_))
    person = F.concat(F.regexp_extract(mention, f"({TITLE})", 1), F.when(name == F.upper(name), F.upper(new)).otherwise(new))

    def as_there(c: Column, k: Column) -> Column:
        there = F.substring(mention, k + 1, F.lit(1))
        return F.when((there != F.lower(there)) & (F.length(F.upper(c)) == 1), F.upper(c)).otherwise(c)

    mixed = F.array_join(F.transform(F.split(surrogate_, ""), as_there), "")
    cased = F.when(mention == F.lower(mention), surrogate_).when(mention == F.upper(mention), F.upper(surrogate_)).otherwise(mixed)
    cased = F.when((kind == "secret") & mention.rlike(PREFIX), surrogate_).otherwise(cased)
    return F.when(kind.isin("card", "ssn", "phone"), digits).when(kind == "iban", iban).when(kind == "person", person).otherwise(cased)


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the mentions in ``text`` replaced, and n_entities, the number of mentions.

    A surrogate depends on the key and the entity: all mentions of an entity, in any spelling and document, get the
    same one, in their own format (check digits of cards and IBANs included), and different entities get different ones. A surname alone
    means the first person of that surname, and of no other gender, whom its document names in full, if any. Texts without a mention stay as they are and are not
    shuffled; the others are joined by a digest of their list of mentions, so copies share one row of surrogates; lists that very many texts have
    are dealt over tasks.
    Cases: null and empty texts stay; every row is treated by its text alone; a format whose values are used up gets longer
    surrogates; an empty table gives no rows; all columns stay, save n_entities, which is replaced.
    """
    docs = docs.drop("n_entities")
    columns = docs.columns
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    rows = docs.withColumn("_found", F.coalesce(found, F.expr("cast(array() as array<string>)")))
    apart = rows.where(F.size("_found") == 0).select(*columns, F.lit(0).alias("n_entities"))
    some = rows.where(F.size("_found") > 0).withColumn("_list", F.md5(F.array_join("_found", "\u0001").cast("binary")))
    lists = checkpointed(some.groupBy("_list").agg(F.first("_found").alias("found"), F.count(F.lit(1)).alias("n")))
    mentions = lists.select(F.explode("found").alias("mention")).groupBy("mention").agg(F.count(F.lit(1)).alias("times")).withColumn("kind", kind_of(F.col("mention")))
    mentions = checkpointed(mentions.withColumn("entity", canonical(F.col("mention"), F.col("kind"))))
    table = mentions.join(assigned(mentions, key), ["kind", "entity"])
    formatted_ = formatted(F.col("mention"), F.col("kind"), F.col("surrogate"))
    person = F.when(F.col("kind") == "person", F.struct(F.col("entity").alias("real"), F.col("surrogate").alias("new")))
    table = checkpointed(table.select("mention", "times", formatted_.alias("new"), person.alias("person")))
    places = lists.select("_list", F.posexplode("found").alias("k", "mention"))
    places = spread_join(places, table, ["mention"], "times", table.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0])
    places = checkpointed(places.select("_list", "k", "mention", "new", "person"))
    named = checkpointed(_whole_names(places))
    places = places.join(named, ["_list", "k"], "left").withColumn("new", F.coalesce("same", "new"))
    news = places.groupBy("_list").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "new"))), lambda s: s["new"]).alias("_new"))
    parts = F.split(F.col(text), ANY, -1)
    whole = F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("a"), F.col("_new").alias("b")), lambda z: F.array(z["a"], F.coalesce(z["b"], F.lit(""))))), "")
    # At most HOT lists are hot: each is copied to SALT places, and its texts go to the one of their partition.
    total = lists.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(checkpointed(lists.where(F.col("n") * HOT >= max(total, SALT * HOT)).select("_list", F.lit(True).alias("_hot"))))
    salt = F.when(F.col("_hot"), F.spark_partition_id() % SALT).otherwise(0)
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), SALT - 1).otherwise(0)))
    news = news.join(hot, "_list", "left").select("_list", "_new", copies.alias("_salt"))
    joined = some.join(hot, "_list", "left").withColumn("_salt", salt).join(news, ["_list", "_salt"])
    return apart.unionByName(joined.withColumn(text, whole).select(*columns, F.size("_found").alias("n_entities")))


def _whole_names(places: DataFrame) -> DataFrame:
    """Rows (_list, k, same): for each surname that stands alone, the surrogate's surname of the first whole name in its list that fits."""
    rows = places.where("person is not null").select("_list", "k", "mention", "person.*")
    rows = rows.withColumn("g", F.substring("real", 1, 1)).withColumn("s", F.lower(surname(F.col("real"))))
    alone = F.size(F.split("real", " ")) == 2  # the gender and one word
    # A title that tells no gender fits any: such rows stand under all genders, and so do whole names for them.
    whole = rows.where(~alone).withColumn("g", F.explode(F.when(F.col("g") == "n", F.array(*map(F.lit, "fmn"))).otherwise(F.array(F.col("g"), F.lit("n")))))
    first = whole.groupBy("_list", "s", "g").agg(F.min(F.struct("k", "new")).alias("owner"))
    name, new = F.regexp_replace("mention", TITLE, ""), surname(F.col("owner.new"))
    same = F.concat(F.regexp_extract("mention", f"({TITLE})", 1), F.when(name == F.upper(name), F.upper(new)).otherwise(new))
    return rows.where(alone).join(first, ["_list", "s", "g"]).select("_list", "k", same.alias("same"))
