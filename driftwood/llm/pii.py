"""Personal data replaced by surrogates: DataFrame functions only.

Entities are found by one pattern; card numbers and IBANs count only with right check digits.  Each becomes units (a name has
one for each word, anything else is one unit) with a kind and a canonical form, and a unit's surrogate is a function of key,
kind, canonical form and attempt: digits give digits, letters letters of the same case, punctuation stays and check
digits are right again; names come from lists of the same gender and script.  Equal units so get equal surrogates in every document.

A name is one identity whatever its title: a given name behind a title without gender (Dr.) has the gender that the corpus
shows for it.  The words of a document's names are replaced wherever they recur in it, title or not.

All distinct units of the corpus are checked: where two share a surrogate, or one is another's original, later attempts are made
until none is left; they draw from ever wider spaces, so that this ends.  The units that needed one, or whose gender
another document tells, are joined back to the documents that hold them; every other surrogate is computed in place.

Not found: names that no title introduces anywhere in the document, names of one letter, and names in scripts without
words (Chinese, Japanese) unless a title and a space stand before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwood.llm.common import drop, fresh, materialize, table, tune

#: A name word: capitalised, or in a script without capitals; particles stay between such words.
_WORD = r"(?:\p{Lu}[\p{L}\p{M}'’-]++|[\p{IsArabic}\p{IsHebrew}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,}+)"
PARTICLES = "van von de der den del della di da du la le bin ibn al el ter".split()
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
MALE = r"Mr\.?|Monsieur|Señor|господин|г-н|Κύριος|السيد"
FEMALE = r"Mrs\.?|Ms\.?|Miss|Madame|Mme|Señora|Señorita|госпожа|г-жа|Κυρία|السيدة"
#: Titles of a language whose nouns are capitalised too: two name words at most.
SHORT_MALE, SHORT_FEMALE = "Herr", "Frau"
EITHER = r"Dr\.?|Prof\.?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})"
#: kind -> pattern, in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}](?:[\p{L}\p{N}.-]*[\p{L}\p{N}])?\.\p{L}{2,}",
    "ipv6": r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])",
    "mac": r"(?<![\p{L}\p{N}:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\p{L}\p{N}:])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)",
    "secret": r"(?<![\p{L}\p{N}_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|sk-[A-Za-z0-9_-]{16,}+|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35})(?![\p{L}\p{N}_])",
    "hex": r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,}+(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}.+-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}]|[.-]\d)",
    "phone": r"(?<![\p{L}\p{N}.+-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4})(?![\p{L}\p{N}]|-\d)",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:(?:{MALE}|{FEMALE}|{EITHER})(?: (?:{_PARTICLE} ){{0,2}}+{_WORD}){{1,4}}+|(?:{SHORT_MALE}|{SHORT_FEMALE})(?: (?:{_PARTICLE} ){{0,2}}+{_WORD}){{1,2}}+)",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every entity contains; texts without it are not searched further.
HINT = r"[0-9@]|AIza|(?:AK|AS)IA|sk-|xox|gh[pousr]_|Mr|Ms|Mme|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|господ|госпож|г-н|г-ж|Κύριος|Κυρία|السيد"

# Common given and family names by gender and script, and syllables of the script.
LATIN = (
    "James John Robert Michael David Thomas Paul Peter Martin Daniel Lucas Felix Hugo Oscar Victor Simon".split(),
    "Mary Anna Linda Laura Sarah Emma Julia Maria Clara Alice Helen Nina Sofia Irene Vera Elisa".split(),
    "Smith Miller Brown Wilson Moore Taylor Martin Weber Fischer Keller Bernard Moreau Garcia Lopez Silva Costa".split(),
    "ba de ki lo mu na pe ri so ta ve wi zo ma le no".split(),
)
CYRILLIC = (
    "Иван Пётр Павел Сергей Андрей Михаил Николай Виктор".split(),
    "Анна Мария Елена Ольга Ирина Вера Нина Татьяна".split(),
    "Иваненко Петренко Шевченко Бондаренко Ткаченко Кравченко Мороз Коваль".split(),
    "ба де ки ло му на пе ри со та ве ви зо ма ле но".split(),
)
GREEK = (
    "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Πέτρος Σπύρος Ανδρέας".split(),
    "Μαρία Ελένη Άννα Κατερίνα Σοφία Βασιλική Ειρήνη Ιωάννα".split(),
    "Παπαδάκης Οικονόμου Γεωργίου Νικολάου Δημητρίου Ιωάννου Αθανασίου Κωνσταντίνου".split(),
    "βα δε κι λο μυ να πε ρι σο τα βε φι ζο μα λε νο".split(),
)
ARABIC = (
    "محمد أحمد علي حسن خالد يوسف عمر إبراهيم".split(),
    "فاطمة مريم عائشة زينب ليلى سارة هدى نور".split(),
    "الحسن المصري الخطيب النجار الحداد الشامي البغدادي العلي".split(),
    "با دي كي لو مو نا في ري سو تا وي زو ما لي نو شا".split(),
)
HAN = (
    "建国 志强 国平 文华 明远 大伟 永福 德海".split(),
    "丽娟 秀英 美玲 桂芳 小红 雪梅 玉兰 春燕".split(),
    "王伟 李娜 张敏 刘洋 陈晨 杨帆 赵磊 黄静".split(),
    "安 宝 晨 德 恩 方 光 海 嘉 康 林 明 宁 平 清 瑞".split(),
)
HANGUL = ("민준 서준 도윤 예준 시우 하준 지호 준우".split(), "서연 서윤 지우 서현 하은 하윤 민서 지유".split(), "김철 이수 박진 최영 정호 강민 조현 윤성".split(), "가 나 다 라 마 바 사 아 자 차 카 타 파 하 고 노".split())
#: Endings of made names, by their script's first syllable: male, female.
ENDINGS = {"ba": ("n", "na"), "ба": ("н", "на"), "βα": ("ς", "να")}
GIVEN_MALE, GIVEN_FEMALE = LATIN[0], LATIN[1]
#: Pattern of a word of each script, its lists; all other words have the Latin ones.
SCRIPTS = [(r"^\p{IsCyrillic}", CYRILLIC), (r"^\p{IsGreek}", GREEK), (r"^\p{IsArabic}", ARABIC), (r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", HAN), (r"^\p{IsHangul}", HANGUL)]
UNIT = "struct<kind:string,raw:string,canon:string>"
NAMES = ("male", "female", "either", "family")


def _list(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _checked(kind: Column, e: Column) -> Column:
    """The kind, or plain for card numbers and IBANs whose check digits are wrong."""
    code = F.regexp_replace(F.upper(e), "[^0-9A-Z]", "")
    wrong = F.when(kind == "card", ~F.call_function("luhn_check", F.regexp_replace(e, "[^0-9]", ""))).when(kind == "iban", _mod97(F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))) != 1)
    return F.when(F.coalesce(wrong, F.lit(False)), "plain").otherwise(kind)


def _mod97(code: Column) -> Column:
    """Letters are two digits (A is 10); the number that results, modulo 97."""
    digit = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(code, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(F.pmod(acc * F.when(c >= "A", 100).otherwise(10) + digit(c), F.lit(97)).cast("int")))


def _entity(e: Column) -> Column:
    """prefix that stays, and units (kind, raw, canon)."""
    title = F.element_at(F.split(e, " "), 1)
    words = F.slice(F.split(e, " "), 2, 20)
    gender = F.when(title.rlike(f"^(?:{MALE}|{SHORT_MALE})$"), "male").when(title.rlike(f"^(?:{FEMALE}|{SHORT_FEMALE})$"), "female").otherwise("either")
    name = lambda w, i: F.struct(F.when(w.isin(PARTICLES), "plain").when(i == F.size(words) - 1, "family").otherwise(gender).alias("kind"), w.alias("raw"), w.alias("canon"))
    kind = F.lit("person")
    for k, pattern in reversed([x for x in KINDS.items() if x[0] != "person"]):
        kind = F.when(e.rlike(f"^(?:{pattern})$"), k).otherwise(kind)
    other = F.struct(_checked(kind, e).alias("kind"), e.alias("raw"), F.regexp_replace(F.lower(e), r"[^\p{L}\p{N}@.]", "").alias("canon"))
    person = kind == "person"
    return F.struct(
        F.when(person, F.concat(title, F.lit(" "))).otherwise("").alias("prefix"),
        F.when(person, F.transform(words, name)).otherwise(F.array(other)).alias("units"),
    )


def _stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Keyed hex digits, two for each significant character."""
    seed = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(F.lit(f"{i}|"), seed), 256) for i in range(4)))


def _byte(stream: Column, n: Column) -> Column:
    """The number of byte n (from 0) of the stream, which repeats."""
    return F.conv(F.substring(stream, F.pmod(n, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _mapped(raw: Column, stream: Column, first: Column, hexadecimal: Column) -> Column:
    """raw with its letters and digits, from significant character first (from 0) on, replaced by others of their class."""

    def one(i: Column) -> Column:
        c = F.substring(raw, i, F.lit(1))
        k = F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), r"[^\p{L}\p{N}]", "")) - 1
        r = _byte(stream, k)
        pick = lambda letters: F.substring(F.lit(letters), F.pmod(r, F.lit(len(letters))) + 1, F.lit(1))
        new = (
            F.when(k < first, c)
            .when(hexadecimal & c.rlike("[0-9a-f]"), pick("0123456789abcdef"))
            .when(hexadecimal & c.rlike("[A-F]"), pick("0123456789ABCDEF"))
            .when(c.rlike("[0-9]"), pick("0123456789"))
            .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуф"))
            .when(c.rlike(r"\p{Lu}"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz"))
        )
        return F.coalesce(new, c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), one), "")


def _named(kind: Column, raw: Column, stream: Column, attempt: Column) -> Column:
    """A name of the same gender, script and case; from the fifth attempt on it is made of ever more syllables, with an ending of its gender."""
    choose = lambda values, n: F.element_at(_list(values), F.pmod(_byte(stream, n), F.lit(len(values))) + 1)

    def of(lists) -> Column:
        male, female, family, syllables = lists
        listed = F.when(kind == "male", choose(male, F.lit(0))).when(kind == "female", choose(female, F.lit(0))).when(kind == "either", choose(male + female, F.lit(0))).otherwise(choose(family, F.lit(0)))
        made = F.array_join(F.transform(F.sequence(F.lit(4), attempt + 2), lambda i: choose(syllables, i)), "")
        male_end, female_end = ENDINGS.get(syllables[0], ("", ""))
        end = F.when(kind == "male", male_end).when(kind == "female", female_end).otherwise("")
        return F.when(attempt < 4, listed).otherwise(F.initcap(F.concat(made, end)))

    name = of(LATIN)
    for pattern, lists in reversed(SCRIPTS):
        name = F.when(raw.rlike(pattern), of(lists)).otherwise(name)
    return F.when((F.length(raw) > 1) & (raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(name)).otherwise(name)


def _with_luhn(number: Column) -> Column:
    """number with its last digit set so that the check holds."""
    start = F.regexp_extract(number, r"^(.*)[0-9]([^0-9]*)$", 1)
    digits = F.reverse(F.regexp_replace(start, "[^0-9]", ""))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, twice(F.substring(digits, i, F.lit(1)).cast("int"))).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))
    return F.concat(start, F.pmod(-total, F.lit(10)).cast("string"))


def _with_iban_check(iban: Column) -> Column:
    """iban with its third and fourth characters set so that the check holds."""
    code = F.regexp_replace(iban, "[^0-9A-Z]", "")
    rest = _mod97(F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 2), F.lit("00")))
    return F.concat(F.substring(iban, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), F.substring(iban, F.lit(5), F.length(iban)))


def _surrogate(kind: Column, raw: Column, canon: Column, attempt: Column, key: str) -> Column:
    def of(stream: Column) -> Column:
        longer = F.when(attempt > 2, F.concat(F.lit("x"), attempt.cast("string"))).otherwise("")
        wider = F.when(attempt > 11, F.concat(F.lit("-"), F.substring(stream, 1, 24))).otherwise("")  # its form has no room left
        local = _mapped(F.substring_index(raw, "@", 1), stream, F.lit(0), F.lit(False))
        domain = F.concat(F.lit("mail"), F.pmod(_byte(stream, F.lit(120)), F.lit(100)).cast("string"), F.lit(".example."), F.element_at(_list(["com", "net", "org"]), F.pmod(_byte(stream, F.lit(121)), F.lit(3)) + 1))
        octet = lambda n: _byte(stream, F.lit(n)).cast("string")
        significant = lambda pattern: F.length(F.regexp_replace(F.regexp_extract(raw, pattern, 0), r"[^\p{L}\p{N}]", ""))
        first = (
            F.when(kind == "secret", significant(r"^(?:AKIA|ASIA|sk-|gh[pousr]_|xox[abprs]-|AIza)"))
            .when(kind == "iban", F.lit(2))
            .when(kind == "card", F.lit(1))
            .when(kind == "phone", significant(r"^(?:\+\d{1,3}(?=[ .(-])|1(?=[ .-]))"))
            .otherwise(0)
        )
        return (
            F.when(kind == "email", F.concat(local, longer, F.lit("@"), domain))
            .when(kind == "plain", raw)
            .when(kind.isin(*NAMES), _named(kind, raw, stream, attempt))
            .when(kind == "ip", F.concat(F.when(attempt < 2, "10").otherwise((F.pmod(_byte(stream, F.lit(3)), F.lit(223)) + 1).cast("string")), F.lit("."), octet(0), F.lit("."), octet(1), F.lit("."), octet(2), wider))
            .when(kind == "ssn", F.concat(F.when(attempt < 2, "9").otherwise(F.substring(_mapped(raw, stream, F.lit(0), F.lit(False)), 1, 1)), F.substring(_mapped(raw, stream, F.lit(0), F.lit(False)), F.lit(2), F.length(raw)), wider))
            .when(kind == "card", F.concat(_with_luhn(_mapped(raw, stream, first, F.lit(False))), wider))
            .when(kind == "iban", F.concat(_with_iban_check(_mapped(raw, stream, first, F.lit(False))), wider))
            .otherwise(F.concat(_mapped(raw, stream, first, kind.isin("hex", "mac", "ipv6")), wider))
        )

    return F.element_at(F.transform(F.array(_stream(kind, canon, attempt, key)), of), 1)


def _canonical(kind: Column, surrogate: Column) -> Column:
    return F.when(kind.isin(*NAMES), surrogate).otherwise(F.regexp_replace(F.lower(surrogate), r"[^\p{L}\p{N}@.]", ""))


def _gendered(units: DataFrame) -> DataFrame:
    """units with told, the kind as the corpus tells it: the gender that a given name has most often where its title has none."""
    votes = units.filter("kind in ('male', 'female')").groupBy("canon").agg(F.sum(F.when(F.col("kind") == "male", F.col("times")).otherwise(-F.col("times"))).alias("vote"))
    told = F.when((F.col("kind") == "either") & F.col("vote").isNotNull(), F.when(F.col("vote") >= 0, "male").otherwise("female")).otherwise(F.col("kind"))
    return units.join(votes, "canon", "left").withColumn("told", told).drop("vote")


def _settled(units: DataFrame, key: str) -> DataFrame:
    """(kind, canon, told, attempt) of the distinct units that need an attempt after the first or another kind; units: kind, canon, raw, times."""
    # names are compared across genders, since their surrogates meet in the same texts
    space = lambda kind: F.when(kind.isin("male", "female", "either"), "given").otherwise(kind)
    units = materialize(_gendered(units))
    state = materialize(units.groupBy(F.col("told").alias("kind"), "canon").agg(F.min("raw").alias("raw")).withColumn("attempt", F.lit(0)))
    originals = units.select(space(F.col("told")).alias("space"), F.col("canon").alias("shape")).distinct()
    while True:
        given = state.withColumns({"shape": _canonical(F.col("kind"), _surrogate(F.col("kind"), F.col("raw"), F.col("canon"), F.col("attempt"), key)), "space": space(F.col("kind"))})
        given = materialize(given)
        shared = given.groupBy("space", "shape").agg(F.min(F.struct("attempt", "canon", "kind")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        again = given.join(shared, ["space", "shape"]).filter("struct(attempt, canon, kind) <> first").select("kind", "canon")
        taken = given.join(originals, ["space", "shape"], "left_semi").select("kind", "canon")
        retry = materialize(again.unionByName(taken).distinct())
        if retry.isEmpty():
            known = state.select(F.col("kind").alias("told"), "canon", "attempt")
            return units.select("kind", "canon", "told").distinct().join(known, ["told", "canon"]).filter("attempt > 0 or told <> kind").select("kind", "canon", "told", "attempt")
        new = materialize(state.join(retry.withColumn("more", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", "raw", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")))
        for t in (given, retry, state):
            drop(t)
        state = new


def _units(found: Column) -> Column:
    """All units of the found entities that are replaced."""
    return F.filter(F.flatten(F.transform(found, lambda e: _entity(e)["units"])), lambda u: u["kind"] != "plain")


def replace_pii(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_entities") -> DataFrame:
    """docs with the entities in text replaced, and their number as a long named by count (which replaces a column of that name; None: not given).

    Null texts stay null with 0 entities; empty texts, repeated rows and empty tables are allowed; all other columns stay as
    they are, whatever their names.  The same key gives the same surrogates for the same corpus; without it they can't be
    traced back.
    """
    tune(docs.sparkSession)
    if count is not None:
        docs = docs.drop(count)
    names, body = docs.columns, F.col(text)
    found_, names_, map_, h_, m_, again_ = fresh(docs, "found", "names", "attempts", "h", "m", "again")
    none = F.array().cast("array<string>")
    every = lambda body: F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0))
    seen = docs.select(body.alias("text")).filter(F.col("text").rlike(HINT)).select(F.explode(_units(every(F.col("text")))).alias("u")).select("u.*")
    exceptions = materialize(_settled(materialize(seen.groupBy("kind", "canon", "raw").agg(F.count("*").alias("times"))), key))

    docs = docs.withColumn(found_, F.coalesce(F.when(body.rlike(HINT), every(body)), none))
    if exceptions.isEmpty():
        docs = docs.withColumn(map_, F.lit(None).cast("map<string,struct<told:string,attempt:int>>"))
    else:
        own = docs.filter(F.size(found_) > 0).select(F.xxhash64(text).alias(h_), F.md5(text).alias(m_), F.explode(_units(F.col(found_))).alias("u")).select(h_, m_, "u.kind", "u.canon").distinct()
        entry = F.struct(F.concat("kind", F.lit("|"), "canon"), F.struct("told", F.col("attempt").cast("int")))
        maps = materialize(own.join(exceptions, ["kind", "canon"]).groupBy(h_, m_).agg(F.map_from_entries(F.collect_set(entry)).cast("map<string,struct<told:string,attempt:int>>").alias(map_)))
        docs = docs.withColumns({h_: F.xxhash64(text), m_: F.md5(text)}).join(maps, [h_, m_], "left")

    # the words of the names in a document, each with its unit; of several kinds the one that tells most comes first
    rank = lambda u: F.when(u["kind"] == "family", 0).when(u["kind"] == "either", 2).otherwise(1)
    words = F.filter(F.flatten(F.transform(F.col(found_), lambda e: _entity(e)["units"])), lambda u: u["kind"].isin(*NAMES) & (F.length(u["raw"]) > 1))
    ranked = F.array_sort(F.array_distinct(F.transform(words, lambda u: F.struct(rank(u).alias("rank"), u["raw"].alias("raw"), u["canon"].alias("canon"), u["kind"].alias("kind")))))
    docs = docs.withColumn(names_, ranked)
    some = F.size(names_) > 0
    listed = F.array_join(F.transform(names_, lambda u: F.concat(F.lit(r"\Q"), u["raw"], F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{M}\p{N}])(?:"), listed, F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    docs = docs.withColumn(again_, F.when(some, F.regexp_extract_all(body, pattern, F.lit(0))).otherwise(F.col(found_)))

    def units(e: Column) -> Column:
        bare = F.filter(F.col(names_), lambda u: u["raw"] == e)
        unit = F.struct(bare[0]["kind"].alias("kind"), bare[0]["raw"].alias("raw"), bare[0]["canon"].alias("canon"))
        return F.when(F.size(bare) > 0, F.struct(F.lit("").alias("prefix"), F.array(unit).alias("units"))).otherwise(_entity(e))

    def replaced(entity: Column) -> Column:
        def unit(u: Column) -> Column:
            other = F.try_element_at(F.col(map_), F.concat(u["kind"], F.lit("|"), u["canon"]))
            return _surrogate(F.coalesce(other["told"], u["kind"]), u["raw"], u["canon"], F.coalesce(other["attempt"], F.lit(0)), key)

        return F.concat(entity["prefix"], F.array_join(F.transform(entity["units"], unit), " "))

    entities = F.transform(F.col(again_), units)
    gaps = F.when(some, F.split(body, pattern, -1)).otherwise(F.split(body, PATTERN, -1))
    joined = F.array_join(F.zip_with(gaps, F.transform(entities, replaced), lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
    if count is None:
        return docs.withColumn(text, F.when(F.size(again_) > 0, joined).otherwise(body)).select(*names)
    number = F.size(F.filter(entities, lambda e: F.exists(e["units"], lambda u: u["kind"] != "plain"))).cast("bigint")
    return docs.withColumns({text: F.when(F.size(again_) > 0, joined).otherwise(body), count: number}).select(*names, count)


def op6_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """doc_id, the rewritten text and the number of entities of every document; the key is a parameter of the session."""
    key = spark.conf.get("driftwood.pii.key", "driftwood")
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
