"""PII: surrogates for detected entities, in DataFrame and SQL expressions only.

Entities are found by one pattern and get a type. Each distinct entity (type and canonical form: emails in
lower case, numbers without separators, phones without the country code 1, the values of secrets, surnames
and given names of persons) gets a surrogate drawn by a keyed hash, so an entity has the same surrogate
wherever and in whatever format it occurs. Surrogates keep the type and the format: character classes and
separators, a card's brand and check digit, an IBAN's country with right check digits, valid octets and the
private range of an address, the first group and the short form of an IPv6 address, a phone's country code or
leading 0, an email's last domain label, a secret's keyword or known prefix (the value is drawn whole), a
person's titles, particles (von, de la), O' and D', hyphens and capitals, with given names of the same gender
and names in the same script. Each word of a name is an entity for itself, so a double surname has the words
of its single ones; the first of several names, and those after it that the list below holds, are given names.
A given name has the gender of the title before it, else of titles before it elsewhere, else of the list.
All surrogates are compared with each other and with all entities; those that coincide are drawn again until
none does. Given names and surnames are compared each for themselves, so different full names stay different.
Persons without a title are found by a given name of the list.

Cases: null text stays null with no entities, empty text stays empty; repeated rows get the same text;
equal entities in any rows get equal surrogates; texts without entities are not touched nor shuffled;
all columns of the input stay, and further columns of any name do not matter; an empty table gives none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, stored

KEY = "tidewell"

# Patterns of entities, titles with the gender they tell, and parts of names.
#: What tokens of well-known services begin with.
PREFIX = r"(?:AKIA|gh[pousr]_|github_pat_|xox[abprs]-|sk-|[rs]k_live_|AIza|eyJ)"
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+|sk-[A-Za-z0-9_\-]{20,}+|[rs]k_live_[A-Za-z0-9]{16,}+|AIza[0-9A-Za-z_\-]{35}|eyJ[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]{8,}+){2})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)[\"']? ?[=:] ?(?:\"[^\"\n]{6,}+(?=\"|\z)|'[^'\n]{6,}+(?='|\z)|[\"']?(?!https?://)[^\s\"',;=:][^\s\"',;]{5,}+)",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])[3-6][0-9]{3}(?:[0-9]{11,12}|([ \-])[0-9]{4}(?:[ \-][0-9]{4}){2}|[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z])",
    # with a country code (1, in groups, other), in the form of North America, national with a leading 0
    "phone": r"(?<![0-9A-Za-z+])(?:\+1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|\+[0-9]{1,3}[ .\-]?(?:\(0\)[ .\-]?)?\(?[0-9]{1,4}\)?(?:[ .\-][0-9]{2,4}){2,5}|\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}"
    r"|(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}"
    r"|0[1-9](?:[ .\-][0-9]{2}){4}|\(0[0-9]{1,4}\) ?[0-9]{3,4}[ \-]?[0-9]{3,5}|0[1-9][0-9]{1,3}[ \-/][0-9]{3,4}[ \-]?[0-9]{3,5})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    # global, unique local and link-local addresses that hold a digit: eight groups, or fewer around ::
    "ip6": r"(?<![0-9A-Za-z.:])(?=[A-Fa-f:]*[0-9])(?:[23][0-9A-Fa-f]{3}|[fF][c-eC-E][0-9A-Fa-f]{2})(?:(?::[0-9A-Fa-f]{1,4}){7}|(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
}
PARTICLES = ["von", "van", "der", "den", "dem", "zu", "zur", "de", "da", "di", "do", "dos", "das", "del", "della", "du", "la", "le", "los", "ten", "ter", "bin", "ibn", "al", "el", "af", "av"]
TITLES = {
    "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Госпожа", "г-жа", "Κυρία"],
    "m": ["Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "Господин", "г-н", "Κύριος"],
    "x": ["Dr.", "Dr", "Doctor", "Prof.", "Prof", "Professor"],
}
FIRST = {
    "f": {
        "latin": ["Anna", "Barbara", "Carmen", "Clara", "Elena", "Elizabeth", "Emma", "Ida", "Jennifer", "Jessica", "Julia", "Karen", "Laura", "Linda", "Lucia", "Maria", "Marie", "Mary", "Nora", "Olivia", "Patricia", "Sabine", "Sarah", "Sophie", "Susan", "Ursula"],
        "cyrillic": ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Юлия"],
        "greek": ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία", "Χριστίνα"],
    },
    "m": {
        "latin": ["Adam", "Bruno", "Carlos", "Charles", "Daniel", "David", "Emil", "Hans", "Hugo", "James", "Jean", "John", "Juan", "Klaus", "Leon", "Matthew", "Michael", "Oscar", "Paul", "Pedro", "Peter", "Pierre", "Richard", "Robert", "Thomas", "William"],
        "cyrillic": ["Антон", "Борис", "Виктор", "Глеб", "Иван", "Олег", "Павел", "Юрий"],
        "greek": ["Ανδρέας", "Γιώργος", "Δημήτρης", "Νίκος", "Πέτρος", "Σταύρος"],
    },
}
#: What drawn given names end in, so that those of different genders differ.
ENDS = {"latin": {"f": "a", "m": "", "x": "i"}, "cyrillic": {"f": "а", "m": "", "x": "и"}, "greek": {"f": "α", "m": "", "x": "ι"}}
SYLLABLES = {
    "latin": ["bar", "cor", "den", "fal", "gar", "hol", "kel", "lin", "mar", "nor", "pel", "ran", "sol", "tam", "var", "wen"],
    "cyrillic": ["бар", "вол", "гор", "дан", "зар", "кел", "лин", "мар", "нор", "пел", "ран", "сол", "там", "фал", "хол", "чер"],
    "greek": ["βαρ", "γορ", "δαν", "ζαρ", "καλ", "λιν", "μαρ", "νορ", "πελ", "ραν", "σολ", "ταμ", "φαλ", "χολ", "ψαλ", "θερ"],
}
#: What a secret keeps, and its value.
WORD = rf"(?s)^((?:[A-Za-z_\-]+[\"']? ?[=:] ?[\"']?)?(?:{PREFIX}(?=.{{6}}))?)(.*)$"
_ALL_TITLES = [t for g in TITLES.values() for t in g]
_ALL_FIRST = [n for g in FIRST.values() for s in g.values() for n in s]
_TITLE = "|".join(t.replace(".", r"\.") for t in _ALL_TITLES)
_TOKEN = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]{1,40}+(?:['’\-]\p{Lu}[\p{L}\p{M}]{1,40}+){0,3}"
_FURTHER = rf" (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}(?!(?:{_TITLE}) ){_TOKEN}"
_GIVEN = "|".join(_ALL_FIRST)
PATTERNS["person"] = rf"(?<![\p{{L}}0-9])(?:(?:(?:{_TITLE}) ){{1,3}}(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_TOKEN}(?:{_FURTHER}){{0,2}}|(?:{_GIVEN})(?:[ \-](?:{_GIVEN}))?(?: \p{{Lu}}\.)?(?:{_FURTHER}){{1,2}})(?![\p{{L}}])"
#: A person's titles, and the words of the name that are replaced.
TITLED = rf"^((?:(?:{_TITLE}) )*)"
NAME_WORD = r"\p{Lu}[\p{L}\p{M}]+"
#: Characters that an entity of each type begins with; looked at first, so that most of a text costs one comparison.
BEGINS = {"secret": "AaegpPrsStTx", "email": r"A-Za-z0-9._%+\-", "iban": "A-Z", "card": "3-6", "phone": r"0-9+(", "ssn": "0-9", "ip": "0-9", "ip6": "23fF", "person": "".join(sorted({t[0] for t in _ALL_TITLES + _ALL_FIRST}))}
ANY = "|".join(f"(?=[{BEGINS[name]}])(?:{p})" for name, p in PATTERNS.items())
#: The same without emails, for texts without an @.
PLAIN = "|".join(f"(?=[{BEGINS[name]}])(?:{p})" for name, p in PATTERNS.items() if name != "email")
HINT = rf"[=:]|(?<![\p{{L}}0-9])(?=[{BEGINS['person']}])(?:{_TITLE}|{_GIVEN})[ \-](?:\p{{Lu}}|(?:{'|'.join(PARTICLES)}) )"


def _found(text: Column) -> Column:
    """Entities in order. Without digits and @ only secrets and persons can occur, which begin with a word of a fixed list."""
    word = F.contains(text, F.lit("AKIA")) | text.rlike(HINT)
    whole = F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    plain = F.when(text.rlike("[0-9]") | word, F.regexp_extract_all(text, F.lit(PLAIN), F.lit(0)))
    return F.coalesce(whole, plain, F.when(text.isNotNull(), F.array().cast("array<string>")))


def _type(entity: Column) -> Column:
    """The type of what the pattern found; null for a number in a card's format with a wrong check digit."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    number = _plain(entity)
    valid = _luhn(F.expr("substring(regexp_replace(entity, '[^A-Za-z0-9]', ''), 1, length(regexp_replace(entity, '[^A-Za-z0-9]', '')) - 1)")) == F.substring(number, -1, 1)
    return F.when((out == "card") & ~valid, F.lit(None)).otherwise(out)


def _plain(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9]", "")


def _canon(type_: Column, entity: Column) -> Column:
    return (
        F.when(type_ == "email", F.lower(entity))
        .when((type_ == "phone") & _plain(entity).rlike("^1[0-9]{10}$"), F.expr("substring(regexp_replace(entity, '[^A-Za-z0-9]', ''), 2)"))
        .when(type_.isin("card", "phone", "ssn", "iban"), _plain(entity))
        .when(type_ == "secret", F.regexp_extract(entity, WORD, 2))
        .when(type_ == "ip6", _groups(entity))
        .otherwise(entity)
    )


def _groups(address: Column) -> Column:
    """The eight groups of an IPv6 address, without leading zeros and in small letters."""
    part = lambda n: F.filter(F.split(F.substring_index(F.lower(address), "::", n), ":"), lambda g: g != "")
    after = F.when(F.contains(address, F.lit("::")), part(-1)).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(part(1)) - F.size(after), F.lit(0)))
    return F.array_join(F.transform(F.concat(part(1), zeros, after), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def _stream(key: str, *parts: Column) -> Column:
    """192 hexadecimal digits from a key and a value."""
    value = F.concat_ws("\x01", F.lit(key), *parts)
    return F.concat(*[F.sha2(F.concat(value, F.lit(f"\x01{i}")), 256) for i in range(3)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 96) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _places(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))


def _redrawn(text: Column, stream: Column, hexadecimal: Column | None = None, others: bool = False) -> Column:
    """Each letter and digit replaced by another of its class; with others, every other character by a small letter."""

    def drawn(given: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            v = _byte(given["stream"], at + 1)
            digit, small = F.chr(F.lit(48) + v % 10), F.chr(F.lit(97) + v % 26)
            out = F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), small).when(c.rlike("[A-Z]"), F.chr(F.lit(65) + v % 26)).otherwise(small if others else c)
            return F.when(given["hexadecimal"] & c.rlike("[a-f]"), F.chr(F.lit(97) + v % 6)).otherwise(out)

        return F.array_join(F.transform(F.split(text, ""), one), "")

    # a secret may be long: its characters come from an array, and what holds for all of them is worked out once
    given = F.array(F.struct(stream.alias("stream"), (F.lit(False) if hexadecimal is None else hexadecimal).alias("hexadecimal")))
    return F.when(F.length(text) > 0, F.get(F.transform(given, drawn), F.lit(0))).otherwise(text)


def _luhn(body: Column) -> Column:
    """The check digit of a number that lacks it."""
    n = F.length(body)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(body, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, F.lit(2)).otherwise(F.lit(1))
        return total + d.cast("int") - F.when(d > 9, F.lit(9)).otherwise(F.lit(0))

    return ((F.lit(10) - F.aggregate(_places(body), F.lit(0), add) % 10) % 10).cast("string")


def _iban(country: Column, account: Column) -> Column:
    """With the check digits that make the number 1 modulo 97."""

    def digits(number: Column) -> Column:
        def add(rest: Column, i: Column) -> Column:
            c = F.substring(number, i, F.lit(1))
            v = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
            return (rest * F.when(v > 9, F.lit(100)).otherwise(F.lit(10)) + v) % 97

        return F.lpad((F.lit(98) - F.aggregate(_places(number), F.lit(0), add) * 100 % 97).cast("string"), 2, "0")

    # the drawn account is worked out once, not for each of its characters
    whole = F.transform(F.array(account), lambda a: F.concat(country, digits(F.concat(a, country)), a))
    return F.get(whole, F.lit(0))


def _address(canon: Column, octets: list[Column]) -> Column:
    """Private addresses stay in their range, unless eight draws were taken; others are never private."""
    first = octets[0] % 219 + 1
    for taken in (10, 127, 172, 192):
        first = first + (first >= taken).cast("int")
    text = [o.cast("string") for o in octets]
    kept = (
        F.when(canon.rlike(r"^(10|127)\."), F.concat_ws(".", F.substring_index(canon, ".", 1), *text[1:]))
        .when(canon.rlike(r"^192\.168\."), F.concat_ws(".", F.lit("192.168"), *text[2:]))
        .when(canon.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), F.concat_ws(".", F.lit("172"), (octets[1] % 16 + 16).cast("string"), *text[2:]))
    )
    return F.coalesce(F.when(F.col("attempt") < 8, kept), F.concat_ws(".", first.cast("string"), *text[1:]))


def _surrogate(key: str) -> Column:
    """The surrogate of the row's type, canon and attempt."""
    type_, canon, attempt = F.col("type"), F.col("canon"), F.col("attempt").cast("string")
    stream = _stream(key, type_, canon, attempt)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    host, last = F.regexp_extract(domain, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(domain, r"^(.*)\.([^.]*)$", 2)
    email = F.concat(_redrawn(local, stream), F.lit("@"), _redrawn(host, _stream(key, F.lit("domain"), domain)), F.lit("."), last)
    octets = [F.conv(F.substring(stream, 3 * i + 1, 3), 16, 10).cast("int") % 254 + 1 for i in range(4)]
    body = F.concat(F.substring(canon, 1, 1), _redrawn(F.expr("substring(canon, 2, length(canon) - 2)"), stream))
    # a phone keeps what stands before its last ten digits; its area and its exchange begin with 2 to 9
    tail = _redrawn(F.substring(canon, -10, 10), stream)
    first = lambda i: (F.lit(2) + F.conv(F.substring(stream, 100 + 2 * i, 2), 16, 10).cast("int") % 8).cast("string")
    phone = F.concat(F.expr("substring(canon, 1, greatest(length(canon) - 10, 0))"), first(0), F.substring(tail, 2, 2), first(1), F.substring(tail, 5, 10))
    phone = F.when(canon.startswith("0"), F.concat(F.lit("0"), first(0), F.substring(_redrawn(canon, stream), 3, 30))).when(F.length(canon) >= 10, phone)
    # all groups of an IPv6 address but the first are drawn, those of zeros only in later attempts
    groups = F.transform(F.split(canon, ":"), lambda g, i: F.when((i == 0) | ((g == "0") & (F.col("attempt") == 0)), g).otherwise(F.lower(F.hex(F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("long") % 65535 + 1))))
    # a secret may have no letter or digit, or few draws of its length may be free: every character is drawn, and more of them after eight attempts
    longer = F.concat(canon, F.repeat(F.lit("a"), F.greatest(F.col("attempt") - 8, F.lit(0))))
    secret = _redrawn(longer, stream, canon.rlike("^[0-9a-f]+$"), others=True)
    script = F.when(canon.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))
    syllable = lambda i, s: F.element_at(F.array(*[F.lit(x) for x in SYLLABLES[s]]), F.conv(F.substring(stream, i + 1, F.lit(1)), 16, 10).cast("int") + 1)
    drawn = lambda s, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n) + F.col("attempt")), lambda i: syllable(i % 180, s)), "")

    def given(gender: str) -> Column:
        """A name of the list at first, drawn ones when those are taken."""
        out = F.lit(None).cast("string")
        for s in SYLLABLES:
            own = [n.lower() for g in (FIRST if gender == "x" else (gender,)) for n in FIRST[g][s]]
            one = F.element_at(F.array(*[F.lit(n) for n in own]), F.conv(F.substring(stream, F.lit(1), F.lit(6)), 16, 10).cast("int") % len(own) + 1)
            out = F.when(script == s, F.when(F.col("attempt") == 0, one).otherwise(F.concat(drawn(s, 1), F.lit(ENDS[s][gender])))).otherwise(out)
        return out

    return (
        F.when(type_ == "email", email)
        .when(type_ == "ip", _address(canon, octets))
        .when(type_ == "ip6", F.array_join(groups, ":"))
        .when(type_ == "card", F.concat(body, _luhn(body)))
        .when((type_ == "phone") & (canon.startswith("0") | (F.length(canon) >= 10)), phone)
        .when(type_ == "iban", _iban(F.substring(canon, 1, 2), _redrawn(F.expr("substring(canon, 5)"), stream)))
        .when(type_ == "secret", secret)
        .when(type_ == "person", F.when(script == "cyrillic", drawn("cyrillic", 3)).when(script == "greek", drawn("greek", 3)).otherwise(drawn("latin", 3)))
        .when(type_ == "given_f", given("f"))
        .when(type_ == "given_m", given("m"))
        .when(type_ == "given_x", given("x"))
        .otherwise(_redrawn(canon, stream))
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """entities (type, canon), repeated or not -> type, canon, core: distinct among surrogates and from all entities of the type."""
    # drawing costs much more than its few bytes tell, so the rows are dealt out and not coalesced by size
    table = entities.groupBy("type", "canon").count().drop("count").repartition(partitions(entities.sparkSession)).withColumn("attempt", F.lit(0))
    table = stored(table.withColumn("core", _surrogate(key)), "surrogates")
    while True:
        shared = table.groupBy("type", "core").agg(F.min("canon").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("type", "core", "keeper")
        real = table.select("type", F.col("canon").alias("core")).withColumn("is_real", F.lit(True))
        clash = table.join(shared, ["type", "core"], "left").join(real, ["type", "core"], "left")
        clash = clash.where("is_real OR canon <> keeper").select("type", "canon")
        clash = stored(clash, "surrogate-clashes")
        if clash.limit(1).count() == 0:
            return table.select("type", "canon", "core")
        marked = table.join(clash.withColumn("again", F.lit(1)), ["type", "canon"], "left")
        marked = marked.withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0))).drop("core")
        table = stored(marked.withColumn("core", _surrogate(key)).drop("again"), "surrogates")


def _formatted() -> Column:
    """The surrogate core in the format of the entity it stands for."""
    entity, core, type_ = F.col("entity"), F.col("core"), F.col("type")
    # a phone's country code is not part of its core
    letters = F.concat(F.when(type_ == "phone", F.expr("substring(regexp_replace(entity, '[^A-Za-z0-9]', ''), 1, length(regexp_replace(entity, '[^A-Za-z0-9]', '')) - length(canon))")).otherwise(""), _plain(core))

    def one(i: Column) -> Column:
        c = F.substring(entity, i, F.lit(1))
        new = F.substring(letters, F.length(_plain(F.substring(entity, F.lit(1), i))), F.lit(1))
        return F.when(c.rlike("[A-Z]"), F.upper(new)).when(c.rlike("[a-z0-9]"), new).otherwise(c)

    short = F.regexp_replace(core, r"^((?:[1-9a-f][0-9a-f]*:)*)0(?::0)*(?::(.*))?$", "$1:$2")
    full = F.array_join(F.transform(F.split(core, ":"), lambda g: F.lpad(g, 4, "0")), ":")
    address = F.when(F.contains(entity, F.lit("::")), short).when(F.length(entity) == 39, full).otherwise(core)
    address = F.when(F.lower(entity) == entity, address).otherwise(F.upper(address))
    secret = F.concat(F.regexp_extract(entity, WORD, 1), core)
    same_length = F.array_join(F.transform(_places(entity), one), "")
    return F.when(type_ == "secret", secret).when(type_ == "ip", core).when(type_ == "ip6", address).otherwise(same_length)


def _words(name: Column) -> Column:
    """The words of a name without its titles, each with whether it is a given name."""
    tokens = F.filter(F.split(name, " "), lambda t: t.rlike(NAME_WORD))
    known = lambda w: F.lower(w).isin([n.lower() for n in _ALL_FIRST])

    def of_token(t: Column, i: Column) -> Column:
        given = lambda w: (i < F.size(tokens) - 1) & ((i == 0) | known(w))
        return F.transform(F.regexp_extract_all(t, F.lit(NAME_WORD), F.lit(0)), lambda w: F.struct(w.alias("word"), given(w).alias("given")))

    return F.flatten(F.transform(tokens, of_token))


def _gender(titles: Column, given: Column) -> tuple[Column, Column]:
    """What titles say, and what the list says of a name."""
    said, listed = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g, scripts in FIRST.items():
        said = F.when(titles.rlike("|".join(rf"(?:^| ){t} ".replace(".", r"\.") for t in TITLES[g])), g).otherwise(said)
        listed = F.when(given.isin([n.lower() for own in scripts.values() for n in own]), g).otherwise(listed)
    return said, listed


def _named(people: DataFrame) -> DataFrame:
    """entity, titles, name -> a row for each word: at, word, canon, type (person or given_ with the gender)."""
    words = people.select("entity", "titles", F.posexplode(_words(F.col("name"))).alias("at", "w")).select("entity", "titles", "at", "w.word", "w.given", F.lower("w.word").alias("canon"))
    said, listed = _gender(F.col("titles"), F.col("canon"))
    words = stored(words.withColumn("said", said).withColumn("listed", listed), "name-words")
    told = words.where("given").groupBy("canon").agg(F.min("said").alias("low"), F.max("said").alias("high"))
    words = words.join(told, "canon", "left")
    gender = F.coalesce("said", F.when(F.col("low") == F.col("high"), F.col("low")), "listed", F.lit("x"))
    return words.withColumn("type", F.when(F.col("given"), F.concat(F.lit("given_"), gender)).otherwise("person"))


def _replacements(entities: DataFrame, key: str) -> DataFrame:
    """Distinct entities with type and surrogate."""
    found = entities.groupBy("entity").count().drop("count").withColumn("type", _type(F.col("entity"))).where("type IS NOT NULL")
    found = found.withColumn("canon", _canon(F.col("type"), F.col("entity"))).withColumn("titles", F.when(F.col("type") == "person", F.regexp_extract("entity", TITLED, 1)))
    found = stored(found.withColumn("name", F.expr("substring(entity, length(titles) + 1)")), "distinct-entities")
    people, others = found.where("type = 'person'"), found.where("type <> 'person'").select("entity", "type", "canon")
    words = _named(people)
    cores = surrogates(others.select("type", "canon").unionByName(words.select("type", "canon")), key)
    cased = F.when(F.upper("word") == F.col("word"), F.upper("core")).otherwise(F.initcap("core"))
    new = words.join(cores, ["type", "canon"]).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("at", cased.alias("new")))).alias("new"))
    between = F.transform(F.split("name", NAME_WORD, -1), lambda x, i: F.concat(x, F.coalesce(F.get(F.col("new"), i)["new"], F.lit(""))))
    people = people.join(new, "entity").select("entity", "type", F.concat("titles", F.array_join(between, "")).alias("surrogate"))
    others = others.join(cores, ["type", "canon"]).select("entity", "type", _formatted().alias("surrogate"))
    return stored(others.unionByName(people), "replacements")


def replace_entities(docs: DataFrame, key: str = KEY) -> tuple[DataFrame, str]:
    """docs with surrogates in text, and the name of a further column: the found entities in order (type, entity, surrogate; those of null type stay)."""
    tag = uuid.uuid4().hex
    c = {x: f"_{x}_{tag}" for x in ("entities", "id", "found", "parts")}
    marked = stored(docs.withColumn(c["entities"], _found(F.col("text"))), "marked")  # the texts are searched once
    some = F.size(c["entities"]) > 0
    nothing = F.array().cast("array<struct<type:string,entity:string,surrogate:string>>")
    dirty = marked.where(some).withColumn(c["id"], F.sha2("text", 256))
    lists = dirty.select(F.col(c["id"]).alias("id"), F.col(c["entities"]).alias("e")).groupBy("id").agg(F.first("e").alias("e"))
    each = stored(lists.select("id", F.posexplode("e").alias("at", "entity")), "entities")
    drawn = each.join(_replacements(each, key), "entity", "left").withColumn("surrogate", F.coalesce("surrogate", "entity"))
    new = drawn.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "type", "entity", "surrogate"))).alias("found"))
    new = new.select(F.col("id").alias(c["id"]), F.transform("found", lambda x: F.struct(x["type"].alias("type"), x["entity"].alias("entity"), x["surrogate"].alias("surrogate"))).alias(c["found"]))
    pieces = F.transform(F.split("text", ANY, -1), lambda p, i: F.concat(p, F.coalesce(F.get(F.col(c["found"]), i)["surrogate"], F.lit(""))))
    replaced = dirty.join(new, c["id"]).withColumn("text", F.array_join(pieces, "")).select(*docs.columns, c["found"])
    clean = marked.where(~F.coalesce(some, F.lit(False))).select(*docs.columns, nothing.alias(c["found"]))
    return clean.unionByName(replaced), c["found"]


def redact(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities, types and replaced (type, entity, surrogate) of each document."""
    out, found = replace_entities(docs.select("doc_id", "text"), key)
    out = out.withColumn(found, F.filter(found, lambda x: x["type"].isNotNull()))
    types = F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["type"]))), ",")
    return out.select("doc_id", "text", F.size(found).cast("long").alias("n_entities"), types.alias("types"), F.col(found).alias("replaced"))
