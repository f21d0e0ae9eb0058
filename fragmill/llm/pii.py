"""Surrogates for personal data, in DataFrame functions only.

Entities (e-mail addresses, telephone, card, account (IBAN) and social security numbers, IPv4 addresses, secrets, up to three names after a title) are found
by one pattern. Each is replaced by a keyed permutation of all entities of its format: its letters and digits are shifted inside their own
alphabets (script, case and digits stay) in a Feistel network, whose rounds hash one half to shift the other. A permutation has
no collisions, so different entities stay different, and equal ones equal, in all documents and without any exchange of data;
`checked` checks that on the data and fails if it isn't so. Names are replaced word by word: given names change places within a list
of their gender, other words are permuted until they are none of the list; titles stay. Check digits of
cards and accounts stay as right or wrong as they were; country codes, exchanges and top-level domains stay.

Defined cases: a null text stays null; a text without entities stays as it is; case and separators don't distinguish entities;
equal rows get equal texts; other columns are untouched, whatever their names. Secrets of over BLOCK characters are permuted in blocks
of about equal length. Key words and hexadecimal digits are found in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, let

KEY = "fragmill"
ROUNDS = 4
BLOCK = 512
#: Permutations that are tried to leave or stay in a class; one is enough but for one word in 10,000 or fewer.
WALK = 8
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
SECRET = r"(?<=[=:\s\"'])(?<=(?i:token|secret|key|password)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_/+-]{8,}+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+"
NAME = r"(?<=(?<!\p{L})(?:Mr|Mrs|Ms|Herr|Frau|Mme|Señor|Señora)\.?\s)\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?(?:\s\p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?){0,2}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])"
KINDS = {"email": EMAIL, "card": CARD, "ssn": SSN, "phone": PHONE, "ip": IP, "secret": SECRET, "name": NAME, "iban": IBAN}
ENTITY = "|".join(KINDS.values())
#: The same with the name as its only group.
NAMED = "|".join(f"({p})" if k == "name" else p for k, p in KINDS.items())
#: Letters that may stand for each other, and given names by gender.
ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåçèéêëìíîïñòóôõöùúûü", "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
]
FEMALE = ["Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nina", "Sofia"]
MALE = ["Adam", "David", "Felix", "Jonas", "Lukas", "Martin", "Oscar", "Peter"]


def partial_step(step, r: int):
    """A function of one argument: Spark counts a lambda's parameters, defaults too."""
    return lambda x: step(x, r)


def _is(k: str):
    return lambda x: x["kind"] == k


def kind(e: Column) -> Column:
    """The kind of an entity by its form. A name of one word that a secret could be is told by `entities`, from where it stands."""
    out = F.lit("name")
    for name in ("secret", "iban", "ip", "phone", "ssn", "card", "email"):
        # A run of 32 hexadecimal digits or more is a secret, whatever it begins with.
        body = {"secret": r"[A-Za-z0-9_/+-]{8,}+", "iban": rf"(?![0-9A-F]{{32,}}+$){IBAN}", "ip": rf"(?:{OCTET}\.){{3}}{OCTET}", "phone": PHONE, "ssn": SSN, "card": CARD, "email": EMAIL}[name]
        out = F.when(e.rlike(f"^(?:{body})$"), F.lit(name)).otherwise(out)
    return out


def _alphabet(c: Column, hexadecimal: Column) -> Column:
    out = F.lit("")
    for a in ALPHABETS:
        out = F.when(F.instr(F.lit(a), c) > 0, F.lit(a)).otherwise(out)
    return F.when(hexadecimal & c.between("a", "f"), F.lit("abcdef")).when(hexadecimal & c.between("A", "F"), F.lit("ABCDEF")).otherwise(out)


def _permuted(e: Column, key: str, movable, hexadecimal: Column | None = None) -> Column:
    """e with the characters i (from 0) for which movable(i, c) holds shifted in their alphabets."""
    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal

    def at(cells: Column) -> Column:
        places = F.filter(cells, lambda x: x["span"] > 0)

        def step(x: Column, r: int) -> Column:
            half = F.floor(F.size(x) / 2).cast("int")
            other = F.transform(F.slice(x, half + 1, F.size(x)) if r % 2 == 0 else F.slice(x, F.lit(1), half), lambda c: c["v"])
            here = (lambda j: j < half) if r % 2 == 0 else (lambda j: j >= half)
            return let(F.xxhash64(F.lit(key), F.lit(r), F.size(x), other), lambda h: F.transform(x, lambda c, j: F.when(here(j), c.withField("v", F.pmod(c["v"] + F.pmod(F.xxhash64(h, j), c["span"]), c["span"]))).otherwise(c)))

        def shuffled(x: Column) -> Column:
            # One symbol is a network of one half only: shifted by the key alone.
            for r in range(ROUNDS):
                x = let(x, partial_step(step, r))
            return x

        drawn = let(F.when(F.size(places) > 0, shuffled(places)).otherwise(places), lambda s: F.map_from_arrays(F.transform(s, lambda c: c["i"]), F.transform(s, lambda c: c["v"])))
        return let(drawn, lambda m: F.array_join(F.transform(cells, lambda c: F.when(c["span"] > 0, F.substring(c["a"], F.element_at(m, c["i"]) + 1, F.lit(1))).otherwise(c["c"])), ""))

    def cell(c: Column, i: Column) -> Column:
        a = F.when(movable(i, c), _alphabet(c, hexadecimal)).otherwise("")
        return let(a, lambda b: F.struct(c.alias("c"), i.alias("i"), b.alias("a"), F.length(b).alias("span"), (F.instr(b, c) - 1).alias("v")))

    return let(F.transform(F.split(e, ""), cell), at)


def _check_digit(digits: Column) -> Column:
    """Luhn's check digit of 15 digits."""
    total = F.aggregate(F.transform(F.slice(digits, 1, 15), lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)), F.lit(0), lambda a, x: a + x)
    return F.pmod(10 - total % 10, F.lit(10))


def _digits(e: Column) -> Column:
    return F.transform(F.filter(F.split(e, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("int"))


def _card(e: Column, key: str) -> Column:
    new = _permuted(e, key + "card", lambda i, c: i < F.length(e) - 1)
    last = F.pmod(F.right(e, F.lit(1)).cast("int") - _check_digit(_digits(e)), F.lit(10))
    return let(new, lambda n: F.concat(F.substring(n, F.lit(1), F.length(n) - 1), F.pmod(last + _check_digit(_digits(n)), F.lit(10)).cast("string")))


def _check_number(e: Column) -> Column:
    """The two check digits that fit an account number without blanks: 98 less the rest by 97 of the number, its country and 00."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) + 9)
    digits = F.filter(F.split(F.concat(F.substring(e, F.lit(5), F.length(e)), F.substring(e, F.lit(1), F.lit(2)), F.lit("00")), ""), lambda c: c.rlike("[0-9A-Z]"))
    return 98 - F.aggregate(digits, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(F.nullif(c, F.lit("")))) % 97)


def _iban(e: Column, key: str) -> Column:
    """Country and grouping stay; check digits stay as far from the right ones as they were."""
    plain = lambda x: F.regexp_replace(x, " ", "")
    off = F.substring(e, F.lit(3), F.lit(2)).cast("int") - _check_number(plain(e))
    new = _permuted(e, key + "iban", lambda i, c: i >= 4)
    return let(new, lambda n: F.concat(F.substring(n, F.lit(1), F.lit(2)), F.lpad(F.pmod(off + _check_number(plain(n)), F.lit(100)).cast("string"), 2, "0"), F.substring(n, F.lit(5), F.length(n))))


def _ip(e: Column, key: str) -> Column:
    octets = F.transform(F.split(e, r"\."), lambda x: x.cast("long"))

    def step(x: Column, r: int) -> Column:
        return F.array(x[1], F.pmod(x[0] + F.pmod(F.xxhash64(F.lit(key + "ip"), F.lit(r), x[1]), F.lit(65536)), F.lit(65536)))

    x = let(octets, lambda o: F.array(o[0] * 256 + o[1], o[2] * 256 + o[3]))
    for r in range(ROUNDS):
        x = let(x, partial_step(step, r))
    return let(x, lambda y: F.concat_ws(".", F.floor(y[0] / 256), y[0] % 256, F.floor(y[1] / 256), y[1] % 256))


def _walked(e: Column, permuted, stays) -> Column:
    """e permuted until stays(it): a permutation of all e that stay, if `permuted` is one of more."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), e, lambda x, i: F.when((i == 0) | ~stays(x), permuted(x)).otherwise(x))


def _word(w: Column, key: str) -> Column:
    listed = lambda x: x.isin(*FEMALE, *MALE)
    out = _walked(w, lambda x: _permuted(x, key + "name", lambda i, c: F.lit(True)), lambda x: ~listed(x))
    for names in (FEMALE, MALE):
        all_ = F.array(*map(F.lit, names))
        shift = 1 + sum(key.encode()) % (len(names) - 1)
        place = F.array_position(all_, w)
        out = F.when(place > 0, F.element_at(all_, (F.pmod(place - 1 + shift, F.lit(len(names))) + 1).cast("int"))).otherwise(out)
    return out


def _name(e: Column, key: str) -> Column:
    blanks = F.concat(F.regexp_extract_all(e, F.lit(r"\s"), F.lit(0)), F.array(F.lit("")))
    return let(F.transform(F.split(e, r"\s"), lambda w: _word(w, key)), lambda w: F.array_join(F.zip_with(w, blanks, lambda a, b: F.concat(a, b)), ""))


def _secret(e: Column, key: str) -> Column:
    """Hexadecimal secrets stay so, AKIA stays in front, and no other secret becomes one of these."""

    def form(x: Column) -> Column:
        return F.when(x.rlike("^[0-9A-Fa-f]+$"), 1).when(x.startswith("AKIA"), 2).otherwise(0)

    def blocks(x: Column, of: Column) -> Column:
        n = F.length(x)
        count = F.ceil(n / BLOCK).cast("int")
        start = lambda i: F.floor(i.cast("long") * n / count).cast("int")

        def block(i: Column) -> Column:
            return let(start(i), lambda a: let(F.substring(x, a + 1, start(i + 1) - a), lambda b: _permuted(b, key + "secret", lambda j, c: ~((of == 2) & (j + a < 4)), of == 1)))

        return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), block), "")

    return let(form(e), lambda of: _walked(e, lambda x: blocks(x, of), lambda x: form(x) == of))


def surrogate(e: Column, k: Column, key: str = KEY) -> Column:
    """The replacement of one entity of kind k."""
    top = F.length(e) - F.length(F.substring_index(e, ".", -1)) - 1
    digits_after = lambda i: F.length(F.regexp_replace(F.substring(e, i + 1, F.length(e)), "[^0-9]", ""))
    return (
        F.when(k == "email", _permuted(e, key + "email", lambda i, c: i < top))
        .when(k == "card", _card(e, key)).when(k == "ip", _ip(e, key)).when(k == "iban", _iban(e, key))
        # The line and the last two digits of the area.
        .when(k == "phone", _permuted(e, key + "phone", lambda i, c: digits_after(i).isin(1, 2, 3, 4, 8, 9)))
        .when(k == "ssn", _permuted(e, key + "ssn", lambda i, c: F.lit(True)))
        .when(k == "secret", _secret(e, key))
        .otherwise(_name(e, key))
    )


def entities(text: Column, key: str = KEY) -> Column:
    """array<struct<kind, e, s>> of the entities in order, with their surrogates. The kind is that of the alternative that matched."""
    found = F.when(text.rlike(r"[0-9@=:]|\p{Lu}\p{Ll}+\.?\s\p{Lu}|AKIA|[A-Fa-f]{32}"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def told(found: Column) -> Column:
        # Only a word of eight ASCII letters or more can be a name and a secret: then the group of the name tells.
        names = F.when(F.exists(found, lambda e: e.rlike("^[A-Z][a-z]{7,}$|^[A-Z][a-z]+-[A-Z][a-z]+$")), F.regexp_extract_all(text, F.lit(NAMED), F.lit(1)))
        return let(names, lambda n: F.transform(found, lambda e, i: let(F.when(F.get(n, i) == e, F.lit("name")).otherwise(kind(e)), lambda k: F.struct(k.alias("kind"), e.alias("e"), surrogate(e, k, key).alias("s")))))

    return let(found, told)


def replaced(text: Column, found: Column) -> Column:
    """text with its entities (all, in order) replaced."""
    gaps = F.split(text, ENTITY, -1)
    whole = let(gaps, lambda g: F.concat(g[0], F.array_join(F.zip_with(F.slice(g, F.lit(2), F.size(g)), found, lambda x, e: F.concat(e["s"], x)), "")))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def pseudonymised(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with surrogates in the text; all columns stay."""
    return docs.withColumn(text, let(entities(F.col(text), key), lambda f: replaced(F.col(text), f)))


def _plain(c: Column, k: Column) -> Column:
    """An entity apart from case and separators."""
    return F.when(k.isin("ip", "email", "secret", "name", "iban"), F.regexp_replace(F.lower(c), r"\s", " ")).otherwise(F.regexp_replace(c, "[^0-9]", ""))


def _pairs(found: Column) -> Column:
    """array<struct<kind, e, surrogate>> for the collision check: of the entities only a hash is kept."""
    return F.array_distinct(F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), F.sha2(_plain(x["e"], x["kind"]), 256).alias("e"), _plain(x["s"], x["kind"]).alias("surrogate"))))


def _shared(pairs: DataFrame) -> DataFrame:
    """(kind, surrogate, n) of surrogates that several entities share, from a table with an array `pairs`."""
    return pairs.select(F.explode("pairs").alias("p")).select("p.*").distinct().groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def collisions(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """(kind, surrogate, n) of surrogates that several entities share, case and separators apart. None are expected."""
    return _shared(docs.select(_pairs(entities(F.col(text), key)).alias("pairs")))


def _verified(df: DataFrame) -> DataFrame:
    """df(row, pairs) written once, and its rows, if no two entities share a surrogate."""
    done = cut(df, "surrogates")
    shared = _shared(done).groupBy("kind").agg(F.count("*").alias("n")).collect()  # a row per kind
    if shared:
        raise RuntimeError("surrogates shared by several entities: " + ", ".join(f"{r.kind} {r.n}" for r in sorted(shared)))
    return done.select("row.*")


def checked(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """pseudonymised, written once and checked for collisions."""
    found = docs.select(F.struct(*docs.columns).alias("row"), entities(F.col(text), key).alias("found"))
    return _verified(found.select(F.col("row").withField(f"`{text}`", replaced(F.col("row")[text], F.col("found"))).alias("row"), _pairs(F.col("found")).alias("pairs")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents with surrogates, and how many entities of each kind were replaced."""
    found = documents(spark, sf_dir).select("doc_id", "text", entities(F.col("text")).alias("found"))
    counts = [F.size(F.filter(F.col("found"), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    row = F.struct("doc_id", F.size("found").cast("long").alias("n_entities"), *counts, replaced(F.col("text"), F.col("found")).alias("text"))
    return _verified(found.select(row.alias("row"), _pairs(F.col("found")).alias("pairs")))
