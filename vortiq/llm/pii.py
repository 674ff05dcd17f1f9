"""Personal data replaced by keyed surrogates, with DataFrame functions only.

One pass over the texts finds entities by their form and marks them. An entity is what all its spellings share: letters
in lower case, digits without marks, a name word by word. Its surrogate is drawn from a keyed hash, so the same entity
gets the same one in every document and spelling, set in the case and marks of the place where it stands; it keeps the
type, the lengths of the format, the script and, for the given name of a person with a title, the gender. Surrogates
that equal each other or a value present in the corpus are drawn again, for the losers alone; after a few attempts they
grow with each one, by a letter, digit or syllable or into a wider range of addresses, so a free value always exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

# Titles, forms of the entities, country codes by length, check digits.
MALE = ["Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Lady", "Frau", "Fräulein", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "Doña", "г-жа", "госпожа"]
NEUTRAL = ["Dr", "Prof", "Professor", "Rev", "Mx"]
#: Titles in capitals, before names in capitals; others stand for too much else.
CAPITALS = {"MR": "m", "MRS": "f", "PROF": "n"}
TITLES = "|".join([*MALE, *FEMALE, *NEUTRAL, *CAPITALS])
#: Words in small letters that join the parts of a name.
PARTICLES = "van|von|der|den|del|della|de|di|da|dos|du|la|le|el|al|bin|ten|ter|zu"
NAME = r"(?:\p{Lu}\.|\p{Lu}['’]\p{Lu}\p{L}+|\p{Lu}\p{L}++(?!\d))"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|(?<![\w+])\+\d{8,14}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])|(?<![\w+.,-])0\d{2,4} \d{3,4} \d{3,4}(?![\w.,-]\d)(?!\w)"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: In order of precedence. No group repeats without a bound, so the longest text needs no deep recursion.
FORMS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}][\p{L}\p{N}.-]*\.\p{L}{2,}"),
    ("phone", rf"(?=[+(\d])(?:{PHONE})"),
    ("ssn", r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("iban", r"(?=[A-Z])(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("card", r"(?=\d)(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("ip", rf"(?=\d)(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\w|\.\d)"),
    ("passport", r"(?=[A-Z\d])(?<=(?:[Pp]assport|[Rr]eisepass|[Pp]asaporte|[Pp]asseport|[Пп]аспорт)(?: (?:[Nn]o|[Nn]r|[Nn]umber|№)\.?)?:? )[A-Z]{0,2}\d{6,9}(?!\w)"),
    ("person", rf"(?=[{''.join(sorted({t[0] for t in TITLES.split('|')}))}])(?<!\p{{L}})(?:{TITLES})\.?[ ](?:(?:{PARTICLES}) ){{0,3}}{NAME}(?:[ -](?:(?:{PARTICLES}) ){{0,3}}{NAME}){{0,2}}"),
]
#: What a text must hold for any of the number forms to match; IBANs may have letters after their first four signs.
NUMBERS = r"[0-9+(][0-9 ().-]{6}|[A-Z]{2}\d\d ?[A-Z0-9]{4}|\d{6}"
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
LATIN = ["ba", "re", "mi", "do", "lan", "ver", "sto", "ken", "ral", "tis", "mon", "fel", "gar", "hol", "win", "dar"]
CYRILLIC = ["ба", "ре", "ми", "до", "лан", "вер", "сто", "кен", "рал", "тис", "мон", "фел", "гар", "хол", "вин", "дар"]
#: Ends of name words by script and role; "s" is a family name that shows no gender.
ENDS = {"latin": {"f": ["a", "ia", "ina", "elle"], "m": ["o", "us", "an", "er"], "n": ["y", "is", "en", "il"], "s": ["t", "ck", "rd", "ng"]}, "cyrillic": {"f": ["а", "ия", "ина", "ова"], "m": ["ов", "ин", "ан", "ер"], "n": ["ко", "ых", "ян", "ец"], "s": ["ко", "ых", "ян", "ец"]}}
MARK, AGAIN = "\x01", "\x02"


def kind_of(value: Column) -> Column:
    out = None
    for name, pattern in FORMS[:-2]:
        own = value.rlike(f"^(?:{pattern})$")
        out = F.when(own, name) if out is None else out.when(own, name)
    return out.when(value.rlike(rf"^(?:{TITLES})\.? "), "person").otherwise("passport")


def _part(kind: Column | str, value: Column | str, first: bool = False) -> Column:
    """kind (null: stays as it is), text, and whether a mention begins here."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).cast("string").alias("kind"), lit(value).cast("string").alias("value"), F.lit(first).alias("begins"))


def _gender(person: Column) -> Column:
    of = lambda titles, gender: "|".join([*titles, *(t for t, g in CAPITALS.items() if g == gender)])
    return F.when(person.rlike(rf"^(?:{of(MALE, 'm')})\b"), "m").when(person.rlike(rf"^(?:{of(FEMALE, 'f')})\b"), "f").otherwise("n")


def _named(person: Column) -> Column:
    """Parts of a person with a title: title, words and what parts them.

    The last word is the family name, all others are given names; particles and initials stay. Kinds: g, s for the role,
    then the gender; a Latin family name shows none, so that Mr and Mrs of one family keep one name.
    """
    gender, words = _gender(person), F.regexp_extract_all(F.regexp_replace(person, rf"^(?:{TITLES})\.? ", ""), F.lit("[ -]|[^ -]+"), F.lit(0))
    last = F.size(words) - 1

    def one(w: Column, i: Column) -> Column:
        role = F.when(i < last, F.concat(F.lit("g"), gender)).when(w.rlike(r"\p{IsCyrillic}"), F.concat(F.lit("s"), gender)).otherwise("s-")
        return F.when(w.rlike(rf"^(?:[ -]|{PARTICLES}|\p{{Lu}}\.)$"), _part(F.lit(None), w)).otherwise(F.struct(role.alias("kind"), w.alias("value"), (i == 0).alias("begins")))

    named = F.transform(words, one)
    # a name counts once, by its first word that is replaced; an initial alone is none
    first = lambda p: F.array_position(F.transform(p, lambda x: x["kind"].isNotNull()), True) - 1
    told = F.transform(named, lambda p, i: F.struct(p["kind"].alias("kind"), p["value"].alias("value"), (i == first(named)).alias("begins")))
    return F.concat(F.array(_part(F.lit(None), F.regexp_extract(person, rf"^(?:{TITLES})\.? ", 0))), told)


def _parts(hit: Column) -> Column:
    """Parts of one hit. An address is a local part, which stands for the whole, and a domain."""
    at = F.substring_index(hit, "@", -1)
    local = F.substr(hit, F.lit(1), F.char_length(hit) - F.char_length(at) - 1)
    return F.when(hit.contains("@"), F.array(_part("email", F.concat(local, F.lit("@"), F.lower(at)), True), _part(F.lit(None), "@"), _part("domain", at))).when(kind_of(hit) == "person", _named(hit)).otherwise(F.array(F.struct(kind_of(hit).alias("kind"), hit.alias("value"), F.lit(True).alias("begins"))))


def _split(text: Column, pattern: Column | str) -> Column:
    """Text between matches at even places, matches at odd ones. text has no MARK that isn't followed by AGAIN."""
    found = F.regexp_replace(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(f"{MARK}$0{MARK}"))
    return F.split(found, f"{MARK}(?!{AGAIN})", -1)


def mark(docs: DataFrame, parts: str) -> DataFrame:
    """docs with the array column `parts` (kind, value, begins) of the texts that hold entities, null elsewhere.

    One pass of one expression, made of the forms that a text can hold at all. Where it finds persons, the capital
    words between the hits are looked up among their names, and names after a title that shows no gender take that of
    the same name elsewhere in the text.
    """
    own = dict(FORMS)
    numbers = "|".join(p for k, p in FORMS if k not in ("email", "person"))
    text = F.replace(F.col("text"), F.lit(MARK), F.lit(MARK + AGAIN))
    forms = F.concat_ws("|", F.when(F.col("text").contains("@"), own["email"]), F.when(F.col("text").rlike(NUMBERS), numbers), F.lit(own["person"]))
    pieces = f"{parts}pieces"
    found = docs.withColumn(pieces, _split(text, forms)).withColumn(pieces, F.when(F.size(pieces) > 1, F.col(pieces)))
    odd = lambda x: F.filter(x, lambda _, i: i % 2 == 1)
    named = F.filter(F.flatten(F.transform(odd(F.col(pieces)), _parts)), lambda p: p.kind.rlike("^[gs].$"))
    named = F.concat(F.filter(named, lambda p: p.kind != "gn"), F.filter(named, lambda p: p.kind == "gn"))
    names = f"{parts}names"
    found = found.withColumn(names, F.aggregate(named, F.lit(None).cast("map<string,string>"), lambda m, p: F.when(F.coalesce(F.map_contains_key(m, p.value), F.lit(False)), m).otherwise(F.map_concat(F.coalesce(m, F.create_map().cast("map<string,string>")), F.create_map(p.value, p.kind)))))

    def between(gap: Column) -> Column:
        kind = lambda w: F.try_element_at(F.col(names), w)
        words = F.transform(_split(gap, r"(?<!\p{L})\p{Lu}\p{L}+"), lambda w, i: F.when((i % 2 == 1) & kind(w).isNotNull(), F.struct(kind(w).alias("kind"), w.alias("value"), F.lit(True).alias("begins"))).otherwise(_part(F.lit(None), w)))
        return F.when(F.col(names).isNotNull(), words).otherwise(F.array(_part(F.lit(None), gap)))

    found = found.withColumn(parts, F.flatten(F.transform(F.col(pieces), lambda x, i: F.when(i % 2 == 1, _parts(x)).otherwise(between(x)))))
    settled = F.transform(parts, lambda p: F.when(p.kind == "gn", F.struct(F.try_element_at(F.col(names), p.value).alias("kind"), p.value.alias("value"), p.begins.alias("begins"))).otherwise(p))
    return found.withColumn(parts, F.when(F.col(names).isNotNull(), settled).otherwise(F.col(parts))).drop(pieces, names)


def canon(kind: Column, value: Column) -> Column:
    """What all spellings of an entity share; telephone numbers of ten digits are those of country code 1, and numbers
    within a country, from 0 on, go by themselves."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").when(value.startswith("0"), "+0").otherwise("+1"), digits)).when(kind.isin("ssn", "card"), digits).when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind.isin("ip", "passport"), value).otherwise(F.lower(value))
    )


def space(kind: Column) -> Column:
    """Within which surrogates must differ: all name words share one."""
    return F.when(kind.rlike("^[gs].$"), "name").otherwise(kind)


def _drawn(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n))


def _extra(attempt: Column, after: int) -> Column:
    """By how much a surrogate has grown: 0 up to that attempt, then one more with each."""
    return F.greatest(attempt - after, F.lit(0))


def _grown(value: Column, extra: Column) -> Column:
    """value with its last letter or digit, of whatever case and script, repeated at the end."""
    last = F.regexp_extract(value, r"([0-9\p{L}])[^0-9\p{L}]*$", 1)
    return F.concat(value, F.repeat(F.when(last == "", "a").otherwise(last), extra))


def _redrawn(value: Column, seed: Column, keep: Column | None = None) -> Column:
    """Every letter and digit drawn anew within its case and script; characters before position keep stay."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), F.substr(F.lit("0123456789"), (_drawn(seed, i, 10) + 1).cast("int"), F.lit(1)))
        for pattern, letters in (("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя"), ("[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), (r"\p{Lu}", "ÀÉÈÊÖÜÄÑÓÍ"), (r"\p{L}", "àéèêöüäñóí")):
            out = out.when(c.rlike(pattern), F.substr(F.lit(letters), (_drawn(seed, i, len(letters)) + 1).cast("int"), F.lit(1)))
        out = out.otherwise(c)
        return out if keep is None else F.when(i < keep, c).otherwise(out)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every other one doubled; the last digit counts once."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x.cast("int"))


def _card(value: Column, longer: Column, seed: Column) -> Column:
    """Keeps the first digit; a number with a right check digit gets one again."""
    drawn = _redrawn(longer, seed, F.lit(1))
    body = F.substr(drawn, F.lit(1), F.char_length(drawn) - 1)
    check = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn(value) % 10 == 0, F.concat(body, check)).otherwise(drawn)


def _mod97(account: Column) -> Column:
    """Remainder by 97 of a bank account number, its first four signs moved to the end, letters as 10 to 35."""
    signs = F.split(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4))), "")
    return F.aggregate(signs, F.lit(0), lambda a, c: F.when(c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97))


def _iban(value: Column, longer: Column, seed: Column) -> Column:
    """Keeps the country; a number with right check digits gets such again."""
    drawn = _redrawn(longer, seed, F.lit(2))
    bare = F.concat(F.substr(drawn, F.lit(1), F.lit(2)), F.lit("00"), F.substr(drawn, F.lit(5)))
    checked = F.concat(F.substr(drawn, F.lit(1), F.lit(2)), F.lpad((F.lit(98) - _mod97(bare)).cast("string"), 2, "0"), F.substr(drawn, F.lit(5)))
    return F.when(_mod97(value) == 1, checked).otherwise(drawn)


def _ip(value: Column, seed: Column, attempt: Column) -> Column:
    """Private and loopback addresses stay within their range (10.*, 127.*, 192.168.*, 172.16.* to 172.31.*), of which
    only the range is kept; others stay outside the reserved ranges.

    Where that is too narrow, private ones are drawn from all of 10.* and loopback ones from all of 127.*, then both from
    the ranges of others; numbers are added at the end where even these are full.
    """
    part = lambda i: (_drawn(seed, F.lit(i), 254) + 1).cast("string")
    private = value.rlike(r"^(10|127|192\.168|172\.(1[6-9]|2\d|3[01]))\.")
    other = F.concat_ws(".", (_drawn(seed, F.lit(0), 100) + 11).cast("string"), part(1))
    wide = F.concat_ws(".", F.when(value.startswith("127."), "127").otherwise("10"), part(1))
    more = F.transform(F.array_repeat(F.lit(""), _extra(attempt, 24)), lambda c, k: (_drawn(seed, k + 4, 254) + 1).cast("string"))
    return F.concat_ws(".", F.when(value.startswith("192.168.") & (attempt < 3), "192.168").when(private & value.startswith("172.") & (attempt < 3), F.concat(F.lit("172."), (_drawn(seed, F.lit(0), 16) + 16).cast("string"))).when(private & (attempt < 12), wide).otherwise(other), part(2), part(3), more)


def _word(kind: Column, value: Column, seed: Column, attempt: Column) -> Column:
    """A name word of the script of value, with an end that shows the role and gender; it grows by syllables."""
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    role = F.when(kind.endswith("-"), "s").otherwise(F.substr(kind, F.lit(2)))
    seed = F.sha2(F.concat(seed, F.lit("|word")), 256)

    def made(script: str) -> Column:
        syllables = F.array(*map(F.lit, LATIN if script == "latin" else CYRILLIC))
        stem = F.transform(F.sequence(F.lit(0), 1 + _extra(attempt, 1)), lambda k: F.element_at(syllables, _drawn(seed, k, 16).cast("int") + 1))
        end = lambda r: F.element_at(F.array(*map(F.lit, ENDS[script][r])), _drawn(seed, F.lit(-1), 4).cast("int") + 1)
        return F.concat(F.array_join(stem, ""), F.when(role == "f", end("f")).when(role == "m", end("m")).when(role == "n", end("n")).otherwise(end("s")))

    return F.when(cyrillic, made("cyrillic")).otherwise(made("latin"))


def seeded(kind: Column, value: Column, attempt: Column, secret: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{secret}|"), kind, F.lit("|"), attempt.cast("string"), F.lit("|"), value), 256)


def drawn(kind: Column, value: Column, attempt: Column, seed: Column) -> Column:
    """The surrogate of an entity (kind, canon) at an attempt; that of an address stands before its own domain.

    seed must be a column of its own, as it is used for every sign.
    """
    longer = _grown(value, _extra(attempt, 8))
    at = F.substring_index(value, "@", -1)
    local = F.substr(value, F.lit(1), F.char_length(value) - F.char_length(at) - 1)
    last = F.substring_index(value, ".", -1)
    first = F.substr(value, F.lit(1), F.char_length(value) - F.char_length(last) - 1)
    return (
        F.when(kind == "email", F.concat(_redrawn(_grown(local, _extra(attempt, 2)), seed), F.lit("@"), at)).when(kind == "domain", F.concat(_redrawn(_grown(first, _extra(attempt, 2)), seed), F.lit("."), last))
        .when(kind == "ip", _ip(value, seed, attempt)).when(kind == "card", _card(value, longer, seed)).when(kind == "iban", _iban(value, longer, seed))
        .when(kind == "phone", _redrawn(longer, seed, F.char_length(F.regexp_extract(value, COUNTRY, 0)))).when(space(kind) == "name", _word(kind, value, seed, attempt)).otherwise(_redrawn(longer, seed))
    )


def _filled(value: Column, signs: Column) -> Column:
    """The letters and digits of signs in the places of those of value, whose marks stay; what is left follows."""
    n = lambda text: F.char_length(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    placed = F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(signs, n(F.substr(value, F.lit(1), i + 1)), F.lit(1))).otherwise(c))
    return F.concat(F.array_join(placed, ""), F.substr(signs, n(value) + 1))


def _cased(value: Column, new: Column) -> Column:
    """new in the capitals of value, sign by sign."""
    pairs = F.zip_with(F.split(new, ""), F.split(value, ""), lambda a, b: F.when(b.rlike(r"\p{Lu}"), F.upper(a)).otherwise(a))
    return F.when(F.lower(value) == value, new).otherwise(F.array_join(pairs, ""))


def shown(kind: Column, value: Column, surrogate: Column) -> Column:
    """A surrogate as value is spelt."""
    before = lambda x: F.substr(x, F.lit(1), F.char_length(x) - F.char_length(F.substring_index(x, "@", -1)) - 1)
    digits = F.regexp_replace(surrogate, "[^A-Z0-9]", "")
    return (
        F.when(kind == "email", _cased(before(value), before(surrogate))).when(kind == "domain", _cased(value, surrogate)).when(kind == "ip", surrogate)
        .when(space(kind) == "name", F.when(F.upper(value) == value, F.upper(surrogate)).otherwise(F.initcap(surrogate)))
        .when(kind == "phone", _filled(value, F.when(value.startswith("+"), digits).otherwise(F.substr(digits, F.lit(2))))).otherwise(_filled(value, digits))
    )


def surrogates(found: DataFrame, secret: str) -> DataFrame:
    """(kind, canon, surrogate) of the distinct entities (kind, canon): one to one, and none is a value of the corpus.

    Each round settles what met nothing; only the rest is drawn again, and looks for what it meets among those settled
    and the values present.
    """
    pending = materialize(found.distinct().withColumn("attempt", F.lit(0)), "entities")
    present = pending.select(space(F.col("kind")).alias("space"), F.col("canon").alias("surrogate"))
    settled: DataFrame | None = None
    while True:
        made = pending.withColumn("seed", seeded(F.col("kind"), F.col("canon"), F.col("attempt"), secret))
        made = made.select("kind", "canon", "attempt", space(F.col("kind")).alias("space"), drawn(F.col("kind"), F.col("canon"), F.col("attempt"), F.col("seed")).alias("surrogate"))
        made = materialize(made, "drawn")
        least = made.groupBy("space", "surrogate").agg(F.min(F.struct("canon", "kind")).alias("least"))
        taken = present if settled is None else present.union(settled.select("space", "surrogate"))
        taken = taken.join(least, ["space", "surrogate"], "left_semi").distinct().withColumn("taken", F.lit(True))
        fate = made.join(least, ["space", "surrogate"]).join(taken, ["space", "surrogate"], "left")
        wins = F.col("taken").isNull() & (F.col("least") == F.struct("canon", "kind"))
        fate = materialize(fate.select("space", "kind", "canon", "surrogate", "attempt", wins.alias("wins")), "fate")
        own = fate.where("wins").select("space", "kind", "canon", "surrogate")
        settled = own if settled is None else settled.union(own)
        pending = fate.where("not wins").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return settled.select("kind", "canon", "surrogate")


def settled_genders(hits: DataFrame) -> DataFrame:
    """Name words after a title that shows no gender take the one that most other titles give the same word in the same
    role anywhere in the corpus (female at ties); where none does, they stay without. So a person is one entity."""
    role = F.substr("kind", F.lit(1), F.lit(1))
    votes = hits.where(F.col("kind").rlike("^[gs][fm]$")).groupBy(role.alias("_role"), F.col("canon").alias("_canon"), "kind").count()
    won = votes.groupBy("_role", "_canon").agg(F.max_by("kind", F.struct(F.col("count"), (F.col("kind").endswith("f")).alias("f"))).alias("_kind"))
    known = F.col("kind").isNull() | ~F.col("kind").rlike("^[gs]n$")
    asked = hits.where(~known).join(won, (role == F.col("_role")) & (F.col("canon") == F.col("_canon")), "left")
    return hits.where(known).unionByName(asked.withColumn("kind", F.coalesce("_kind", "kind")).select(*hits.columns))


def replace(docs: DataFrame, secret: str, found: str = "n_pii") -> DataFrame:
    """docs with the entities of text replaced; their number in each text is added as the column `found`. All else stays
    as it is.

    secret is the key: whoever has it can compute the surrogates, so it has no default and an empty one is refused.
    Bare words of a name that stands with a title in the same text are replaced alike; particles and initials of a name
    stay. A name after a title without gender is that of the same name with one, in whatever document. A null text stays null and an
    empty one empty, with 0 found; a text without entities is unchanged. Repeated rows stay, each replaced alike. A
    column of docs of that name is overwritten. Texts without entities aren't shuffled; the entities of a text are
    rows of their own until they are joined back, so that a text may hold any number of them.
    """
    if not secret:
        raise ValueError("a key is needed for surrogates")
    columns = [c for c in docs.columns if c.lower() != found.lower()]
    prefix = fresh(columns, "pii")
    row, parts, new = prefix + "row", prefix + "parts", prefix + "new"
    scanned = mark(docs.select(*columns), parts)
    text = F.when(F.col(parts).isNull(), F.col("text"))
    scanned = materialize(scanned.select(*[text.alias(c) if c == "text" else F.col(c) for c in columns], parts, F.monotonically_increasing_id().alias(row)), "scanned")
    has = F.col(parts).isNotNull()
    hits = scanned.where(has).select(F.col(row).alias("row"), F.posexplode(parts).alias("at", "part")).where("part.kind is not null").select("row", "at", "part.kind", "part.value", canon(F.col("part.kind"), F.col("part.value")).alias("canon"))
    hits = materialize(settled_genders(hits), "hits")
    made = surrogates(hits.select("kind", "canon"), secret)
    put = hits.join(made, ["kind", "canon"]).select("row", "at", shown(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new"))
    put = put.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias(new))
    joined = scanned.where(has).join(put, row)
    plain = F.filter(F.transform(parts, lambda p, i: F.when(p.kind.isNull(), F.struct(i.alias("at"), p.value.alias("new")))), lambda p: p.isNotNull())
    whole = F.array_join(F.transform(F.array_sort(F.concat(plain, F.col(new))), lambda p: p["new"]), "")
    whole = F.replace(whole, F.lit(MARK + AGAIN), F.lit(MARK))
    done = joined.select(*[whole.alias("text") if c == "text" else F.col(c) for c in columns], F.size(F.filter(parts, lambda p: p.begins)).cast("long").alias(found))
    return done.union(scanned.where(~has).select(*columns, F.lit(0).cast("long").alias(found)))
