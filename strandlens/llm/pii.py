"""Personal data: keyed surrogates for detected entities, with DataFrame functions only.

Each entity is replaced by one of its own type, gender, script and format, derived from a key: equal
entities get equal surrogates wherever they stand (coreference), different entities different ones
(distinctness), which is checked over the whole table and repaired by deriving again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop_written, written

#: Titles that show a person's name and gender, by script.
MALE = ("Mr", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Г-н", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "Mlle", "Г-жа", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor")

#: Syllables and gendered endings from which names are composed, by script.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe fi ga ge go ha he hi ja jo ka ke ki la le li lo ma me mi mo na ne ni no pa pe pi ra re ri ro sa se si so ta te ti to va ve vi wa we za ze zi bra dre fri gro kla ple tra vre sti".split(), ("n", "r", "s", "k"), ("a", "ia", "ina", "ela")),
    "cyrillic": ("ба бе бо ва ве во га го да де до жа зи ка ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то фа хо".split(), ("в", "н", "р", "м"), ("а", "ина", "ова", "ия")),
    "greek": ("βα βε βι γα γε δα δε δι ζα θα θε κα κε κι λα λε λι μα με μι να νε νι πα πε πι ρα ρε ρι σα σε σι τα τε τι φα χα".split(), ("ς", "ος", "ης", "ας"), ("α", "η", "ια", "ινα")),
}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}

_TITLE = rf"(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})"
_NAME = r"\p{Lu}\p{Ll}++"
_LABEL = r"[\p{L}\p{N}\-]++"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+\-])[\p{{L}}\p{{N}}._%+\-]++@{_LABEL}(?:\.{_LABEL})++"
SECRET = r"(?i:token|api[_\-]?key|secret|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_\-]{12,}+[\"']?"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IP = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\d+(])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\) ?|\d{3}[.\-])\d{3}[ .\-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)"
CARD = r"(?<!\d)(?:\d{4}[ \-]){3}\d{1,7}(?!\d)|(?<!\d)\d{13,19}(?!\d)"
_TITLES = rf"(?:{_TITLE}\.?\s)"
NAME = rf"(?<!\p{{L}}){_TITLES}++{_NAME}(?:[ \-]{_NAME})?+"
_INITIALS = "".join(sorted({t[0] for t in (*MALE, *FEMALE, *NEUTRAL)}))
#: Each kind behind a look at its first character, which most places in a text don't have.
ENTITY = rf"{EMAIL}|(?=[\d(+])(?:{IP}|{SSN}|{PHONE}|{CARD})|(?=[aApPsStT]){SECRET}|(?=[A-Z]){IBAN}|(?=[{_INITIALS}]){NAME}"
#: What every entity has: a cheap test before the full expression.
HINT = rf"[@\d]|[=:]\s{{0,3}}[\"']?[\w\-]{{12}}|(?=[{_INITIALS}]){_TITLE}\.?\s"

#: The type of what looks like an entity but fails its check digits: it stays as it is.
NONE = "none"
MENTION = "array<struct<e:string,type:string,norm:string,attempt:int>>"


def entities(text: Column) -> Column:
    """The entity strings of a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


def _words(e: Column) -> Column:
    return F.regexp_replace(e, rf"^{_TITLES}+", "")


def _in(title: Column, titles: tuple[str, ...]) -> Column:
    return title.isin(*titles)


def kind(e: Column) -> Column:
    """The entity's type; for names also the gender, by title or else by the given name's ending. Long
    numbers and account numbers whose check digits are wrong are none, nor are long numbers that begin
    like no issuer's."""
    title = F.regexp_extract(e, rf"^({_TITLE})\.?\s", 1)
    woman = _in(title, FEMALE) | (~_in(title, MALE) & F.split(F.lower(_words(e)), "[ -]")[0].rlike("[aаαη]$"))
    return (
        F.when(e.contains("@"), "email")
        .when(title != "", F.when(woman, "name_f").otherwise("name_m"))
        .when(e.rlike(r"^(?i:token|api|secret|passw)"), "secret")
        .when(e.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), F.when(_mod97(_turned(F.replace(e, F.lit(" "), F.lit("")))) == 1, "iban").otherwise(NONE))
        .when(e.rlike(r"^\+|^\(|^\d{3}[.\-]\d{3}[ .\-]\d{4}$"), "phone")
        .otherwise(F.when(e.rlike(r"^[2-6]") & (_luhn(_digits(e)) % 10 == 0), "card").otherwise(NONE))
    )


def norm(e: Column, type_: Column) -> Column:
    """What mentions of one entity have in common, whatever their case and separators."""
    country = F.regexp_extract(e, r"^\+(\d{1,3})[ .\-(]", 1)
    national = F.substring(_digits(e), F.length(country) + 1, F.lit(40))
    return (
        F.when(type_ == "email", F.lower(e))
        .when(type_.startswith("name"), F.lower(_words(e)))
        .when(type_ == "secret", F.regexp_extract(e, r"([A-Za-z0-9_\-]{12,}+)[\"']?$", 1))
        .when(type_ == "ip", e)
        .when(type_ == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .when(type_ == "phone", F.concat(country, F.lit(":"), national))
        .otherwise(_digits(e))
    )


def mentions(text: Column) -> Column:
    """entities() with their types and norms, as an array of structs with attempt 0."""
    typed = F.transform(entities(text), lambda e: F.struct(e.alias("e"), kind(e).alias("type")))
    return F.transform(typed, lambda m: F.struct(m["e"].alias("e"), m["type"].alias("type"), norm(m["e"], m["type"]).alias("norm"), F.lit(0).alias("attempt")))


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def _pick(h: Column, i: Column | int, n: int) -> Column:
    """A number below n from byte pair i of a 64-digit hash."""
    at = (F.lit(i) if isinstance(i, int) else i) % F.lit(30)
    return _number(F.substring(h, (at * 2 + 1).cast("int"), F.lit(4))) % n


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of 10 for valid card numbers."""
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))
    return F.aggregate(places, F.lit(0), lambda total, i: total + _luhn_digit(F.coalesce(F.substring(digits, F.length(digits) - i + 1, F.lit(1)).try_cast("int"), F.lit(0)), i))


def _luhn_digit(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, d).otherwise(F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))


def _turned(iban: Column) -> Column:
    """An account number with its first four characters last, as the check goes over it."""
    return F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))


def _mod97(s: Column) -> Column:
    """The number modulo 97 that digits and letters (A is 10) spell."""

    def step(total: Column, i: Column) -> Column:
        c = F.substring(s, i, F.lit(1))
        return F.coalesce((total * 10 + c.try_cast("int")) % 97, (total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), F.lit(0), step)


def _letter(c: Column, h: Column, i: Column) -> Column:
    """A character of the same class and script in place of c; signs stay."""
    def among(letters: str) -> Column:
        return F.substring(F.lit(letters), (_pick(h, i, len(letters)) + 1).cast("int"), F.lit(1))

    lower, greek, cyrillic = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзиклмнопрстуфхцчшщэюя"
    latin = F.when(c.rlike(r"\p{Lu}"), among(lower.upper())).otherwise(among(lower))
    return (
        F.when(c.rlike(r"\d"), among("0123456789"))
        .when(c.rlike(SCRIPTS["cyrillic"]), among(cyrillic))
        .when(c.rlike(SCRIPTS["greek"]), among(greek))
        .when(c.rlike(r"\p{L}"), latin)
        .otherwise(c)
    )


def _mapped(s: Column, h: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0))), lambda i: _letter(F.substring(s, (i + 1).cast("int"), F.lit(1)), h, i)), "")


def _hex(s: Column, h: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - 1, F.lit(0))), lambda i: F.substring(F.lit("0123456789abcdef"), (_pick(h, i, 16) + 1).cast("int"), F.lit(1))), "")


def _account(country: Column, body: Column) -> Column:
    """An account number with right check digits."""
    check = F.lpad((F.lit(98) - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, check, body)


def _person(word: Column, h: Column, attempt: Column, ending: Column | None) -> Column:
    """A word composed of syllables of the word's script; a further syllable for each attempt."""

    def of(script: str) -> Column:
        syllables, man, woman = SYLLABLES[script]
        table = F.array(*[F.lit(s) for s in syllables])
        body = F.array_join(F.transform(F.sequence(F.lit(0), 2 + attempt), lambda i: F.element_at(table, (_pick(h, i * 2, len(syllables)) + 1).cast("int"))), "")
        men, women = (F.element_at(F.array(*[F.lit(x) for x in xs]), (_pick(h, 14, len(xs)) + 1).cast("int")) for xs in (man, woman))
        return F.initcap(F.concat(body, men if ending is None else F.when(ending == "name_f", women).otherwise(men)))

    return F.when(word.rlike(SCRIPTS["cyrillic"]), of("cyrillic")).when(word.rlike(SCRIPTS["greek"]), of("greek")).otherwise(of("latin"))


def canonical(found: Column, key: str) -> Column:
    """The surrogate norm of each mention, as an array of strings.

    Numbers of up to 19 digits and addresses go through a keyed Feistel permutation of their kind,
    so equally long ones can't collide; check digits of card and account numbers are right again,
    and a card keeps the first digit.
    Other kinds draw characters or syllables from a keyed hash. ``attempt`` gives other surrogates.
    """

    def parts(m: Column) -> Column:
        number = F.when(m["type"] == "phone", F.substring_index(m["norm"], ":", -1)).otherwise(m["norm"])
        valid = m["type"] == "card"
        body = F.when(valid, F.substring(number, F.lit(2), F.length(number) - 2)).otherwise(number)
        return F.struct(m["type"].alias("type"), m["norm"].alias("norm"), m["attempt"].alias("attempt"), valid.alias("valid"), body.alias("body"), _hash(key, m["type"], m["norm"], m["attempt"]).alias("h"))

    def halves(m: Column) -> Column:
        n = F.length(m["body"])
        u = F.floor(n / 2).cast("int")
        octet = [F.coalesce(F.split(m["norm"], r"\.")[i].try_cast("long"), F.lit(0).cast("long")) if i == 0 else F.coalesce(F.get(F.split(m["norm"], r"\."), F.lit(i)).try_cast("long"), F.lit(0).cast("long")) for i in range(4)]
        ip = m["type"] == "ip"
        small = F.least(n, F.lit(19))
        size = lambda digits: F.greatest(F.pow(F.lit(10.0), digits.cast("double")).cast("long"), F.lit(1).cast("long"))
        left = F.coalesce(F.substring(m["body"], F.lit(1), u).try_cast("long"), F.lit(0).cast("long"))
        right = F.coalesce(F.substring(m["body"], u + 1, F.lit(40)).try_cast("long"), F.lit(0).cast("long"))
        zero = F.lit(65536).cast("long")
        return F.struct(
            *[m[c].alias(c) for c in ("type", "norm", "attempt", "valid", "body", "h")], u.alias("u"), (small - u).alias("v"),
            F.when(ip, octet[0] * 256 + octet[1]).otherwise(left).alias("a"), F.when(ip, octet[2] * 256 + octet[3]).otherwise(right).alias("b"),
            F.when(ip, zero).otherwise(size(F.least(u, F.lit(10)))).alias("ma"), F.when(ip, zero).otherwise(size(F.least(small - u, F.lit(10)))).alias("mb"),
        )

    def turn(r: int):
        def step(m: Column) -> Column:
            own, other, size = ("a", "b", "ma") if r % 2 else ("b", "a", "mb")
            f = _number(F.substring(_hash(key, m["type"], m["attempt"], F.lit(r), m["ma"], m["mb"], m[other]), 1, 14))
            moved = F.pmod(m[own] + f % m[size], m[size])
            return F.struct(*[(moved if c == own else m[c]).alias(c) for c in ("type", "norm", "attempt", "valid", "body", "h", "u", "v", "a", "b", "ma", "mb")])

        return step

    def joined(m: Column) -> Column:
        both = F.concat(F.when(m["u"] > 0, F.lpad(m["a"].cast("string"), m["u"], F.lit("0"))).otherwise(""), F.lpad(m["b"].cast("string"), F.greatest(m["v"], F.lit(1)), F.lit("0")))
        number = F.when(F.length(m["body"]) > 19, _mapped(m["body"], m["h"])).otherwise(both)
        issued = F.concat(F.substring(m["norm"], F.lit(1), F.lit(1)), number)
        check = F.pmod(F.lit(10) - _luhn(F.concat(issued, F.lit("0"))) % 10, F.lit(10)).cast("string")
        dotted = F.concat_ws(".", F.floor(m["a"] / 256).cast("string"), (m["a"] % 256).cast("string"), F.floor(m["b"] / 256).cast("string"), (m["b"] % 256).cast("string"))
        more = F.when(m["attempt"] > 2, F.substring(m["h"], F.lit(1), m["attempt"])).otherwise("")
        domain = F.substring_index(m["norm"], ".", -1)
        head = F.substring(m["norm"], F.lit(1), F.length(m["norm"]) - F.length(domain))
        given, family = F.split(m["norm"], "[ -]", 2)[0], F.element_at(F.split(m["norm"], "[ -]", 2), -1)
        extra = F.when(m["attempt"] > 0, m["attempt"]).otherwise(F.lit(0))
        last = _person(family, _hash(key, F.lit("family"), family, extra), extra, None)
        first = F.when(given == family, F.lit("")).otherwise(F.concat(_person(given, _hash(key, m["type"], F.lit("given"), given), F.lit(0), m["type"]), F.lit(" ")))
        return (
            F.when(m["type"] == "email", F.concat(more, _mapped(head, m["h"]), domain))
            .when(m["type"].startswith("name"), F.concat(first, last))
            .when(m["type"] == "secret", F.concat(F.when(m["norm"].rlike("^[0-9a-fA-F]+$"), F.when(m["norm"].rlike("[A-F]"), F.upper(_hex(m["norm"], m["h"]))).otherwise(_hex(m["norm"], m["h"]))).otherwise(_mapped(m["norm"], m["h"])), more))
            .when(m["type"] == "iban", _account(F.substring(m["norm"], F.lit(1), F.lit(2)), _mapped(F.substring(m["norm"], F.lit(5), F.length(m["norm"])), m["h"])))
            .when(m["type"] == "ip", dotted)
            .when(m["type"] == "phone", F.concat(F.substring_index(m["norm"], ":", 1), F.lit(":"), number))
            .otherwise(F.when(m["valid"], F.concat(issued, check)).otherwise(number))
        )

    steps = F.transform(F.transform(found, parts), halves)
    steps = reduce(lambda column, r: F.transform(column, turn(r)), range(1, 7), steps)
    return F.transform(steps, joined)


def dressed(m: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format: its separators, title, quotes and case."""
    e = m["e"]
    national = F.when(m["type"] == "phone", F.concat(F.substring_index(surrogate, ":", 1), F.substring_index(surrogate, ":", -1))).otherwise(surrogate)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(acc: Column, i: Column) -> Column:
        c = F.substring(e, i, F.lit(1))
        own = F.when(m["type"] == "iban", c != " ").otherwise(c.rlike(r"\d"))
        return F.struct(F.concat(acc["out"], F.when(own, F.substring(national, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + own.cast("int")).alias("at"))

    spaced = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(e), F.lit(1))), start, put, lambda acc: acc["out"])
    cased = F.when(e == F.upper(e), F.upper(surrogate)).when(F.substring(e, F.lit(1), F.lit(1)).rlike(r"\p{Lu}"), F.concat(F.upper(F.substring(surrogate, F.lit(1), F.lit(1))), F.substring(surrogate, F.lit(2), F.length(surrogate)))).otherwise(surrogate)
    named = F.when(_words(e).contains("-"), F.replace(surrogate, F.lit(" "), F.lit("-"))).otherwise(surrogate)
    return (
        F.when(m["type"] == NONE, e)
        .when(m["type"] == "email", cased)
        .when(m["type"].startswith("name"), F.concat(F.regexp_extract(e, rf"^{_TITLES}+", 0), named))
        .when(m["type"] == "secret", F.replace(e, m["norm"], surrogate))
        .when(m["type"] == "ip", surrogate)
        .otherwise(spaced)
    )


def _surrogate(df: DataFrame, key: str) -> DataFrame:
    """df (type, norm, attempt) plus surrogate."""
    one = F.array(F.struct(F.lit("").alias("e"), "type", "norm", "attempt"))
    return df.withColumn("surrogate", canonical(one, key)[0])


def retries(found: DataFrame, key: str) -> DataFrame:
    """(type, norm, attempt), written, of the entities whose first surrogate isn't usable; found:
    distinct (type, norm).

    A surrogate is usable if no other entity of the type has it and it is no entity of the table
    itself. Of several that share one the first by norm keeps it. The others try again against all
    that are settled, until none is left; from the third attempt on surrogates grow longer, so the
    rounds end. Joins are on (type, surrogate), of which no value is frequent.
    """
    real = found.select(F.col("type").alias("type"), F.col("norm").alias("surrogate"))
    order = Window.partitionBy("type", "surrogate").orderBy("norm")
    tables: list[DataFrame] = []

    def judged(tried: DataFrame, settled: DataFrame | None) -> DataFrame:
        taken = real if settled is None else real.unionByName(settled.select("type", "surrogate"))
        marked = tried.join(taken.distinct().withColumn("__taken", F.lit(True)), ["type", "surrogate"], "left")
        tables.append(written(marked.withColumn("ok", F.col("__taken").isNull() & (F.row_number().over(order) == 1)).select("type", "norm", "attempt", "surrogate", "ok"), "surrogates"))
        return tables[-1]

    now = judged(_surrogate(found.withColumn("attempt", F.lit(0)), key), None)
    settled, late = now.where("ok"), found.where("false").withColumn("attempt", F.lit(0))
    while True:
        again = now.where("not ok").select("type", "norm", (F.col("attempt") + 1).alias("attempt"))
        if not again.limit(1).count():
            break
        now = judged(_surrogate(again, key), settled)
        fresh = now.where("ok")
        settled = settled.unionByName(fresh)
        late = late.unionByName(fresh.select("type", "norm", "attempt"))
    out = written(late, "retries")
    drop_written(*tables)
    return out


def known_names(put: Column) -> Column:
    """(old, new) words of the names among replaced mentions (type, old, new)."""
    names = F.filter(put, lambda p: p["type"].startswith("name"))
    words = F.transform(names, lambda p: F.zip_with(F.split(_words(p["old"]), "[ -]"), F.split(_words(p["new"]), "[ -]"), lambda a, b: F.struct(a.alias("old"), b.alias("new"))))
    return F.filter(F.flatten(words), lambda w: w["old"].isNotNull() & w["new"].isNotNull())


def renamed(piece: Column, words: Column) -> Column:
    """A piece of text with the known words of names replaced, where they stand as whole words."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{M}])(?:"), F.array_join(F.array_distinct(F.transform(words, lambda w: w["old"])), "|"), F.lit(r")(?![\p{L}\p{M}])"))
    hits = F.transform(F.regexp_extract_all(piece, pattern, F.lit(0)), lambda h: F.element_at(F.filter(words, lambda w: w["old"] == h), 1)["new"])
    return F.array_join(F.zip_with(F.split(piece, pattern, -1), hits, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """docs with every detected entity in its text replaced, plus the number of entities.

    Emails, secrets in assignments, IPv4 addresses, phone, social security, card and account
    numbers, and names after a title are replaced; in a text with such a name its words are also
    replaced where they stand without the title. All other characters stay, numbers with wrong
    check digits among them. A null text stays null with 0 entities, an empty one empty; repeated
    rows get equal texts; other columns are passed on, an existing ``count_col`` is replaced (None:
    no count); an empty table gives an empty result. Texts are not shuffled unless more than 20,000
    of them hold an entity that had to be derived again.
    """
    text = F.col(text_col)
    row = F.xxhash64(F.col(id_col), text)
    seen = docs.where(text.rlike(HINT)).select(row.alias("__row"), F.explode(mentions(text)).alias("m")).where(F.col("m.type") != NONE)
    seen = written(seen.select("__row", "m.type", "m.norm").distinct(), "mentions")
    again = retries(seen.select("type", "norm").distinct(), key)
    known = docs.withColumn("__found", F.coalesce(mentions(text), F.array().cast(MENTION)))
    n = again.count()
    if n:
        entry = F.struct(F.concat_ws("|", "type", "norm").alias("k"), F.col("attempt").alias("v"))
        per_row = seen.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, ["type", "norm"]).groupBy("__row").agg(F.map_from_entries(F.collect_set(entry)).alias("__attempts"))
        per_row = written(per_row, "attempts")
        known = known.withColumn("__own", row).join(F.broadcast(per_row) if per_row.count() <= BROADCAST_ROWS else per_row, F.col("__own") == F.col("__row"), "left")
        attempt = lambda m: F.coalesce(F.try_element_at(F.col("__attempts"), F.concat_ws("|", m["type"], m["norm"])), F.lit(0))
        known = known.withColumn("__found", F.transform("__found", lambda m: F.struct(m["e"].alias("e"), m["type"].alias("type"), m["norm"].alias("norm"), attempt(m).alias("attempt"))))
    drop_written(seen, again)
    put = F.zip_with("__found", canonical(F.col("__found"), key), lambda m, s: F.struct(m["type"].alias("type"), m["e"].alias("old"), dressed(m, s).alias("new")))
    known = known.withColumn("__put", F.when(F.size("__found") > 0, put))
    words = known_names(F.col("__put"))
    plain = F.zip_with(F.split(text, ENTITY, -1), F.col("__put"), lambda a, p: F.concat(F.coalesce(a, F.lit("")), F.coalesce(p["new"], F.lit(""))))
    named = F.zip_with(F.split(text, ENTITY, -1), F.col("__put"), lambda a, p: F.concat(F.coalesce(renamed(a, words), F.lit("")), F.coalesce(p["new"], F.lit(""))))
    has_name = F.exists("__put", lambda p: p["type"].startswith("name"))
    replaced = F.when(F.col("__put").isNull(), text).when(has_name, F.array_join(named, "")).otherwise(F.array_join(plain, ""))
    columns = [replaced.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != count_col]
    total = F.size(F.filter("__found", lambda m: m["type"] != NONE))
    return known.select(*columns, *([total.alias(count_col)] if count_col else []))
