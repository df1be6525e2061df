"""PII surrogates (DataFrame and SQL functions only).

Entities (e-mail addresses, phone numbers, card numbers, IPv4 and IPv6 addresses, social security numbers,
IBANs, person names) are found by one alternation over the whole text.  Every distinct entity of the
corpus gets one keyed surrogate of its kind:

* numbers keep length and separators (a card number that passes the Luhn check gets one that does);
* e-mail addresses and IBANs keep their shape letter by letter, in the same script and case;
* names are handled word by word, so "John Smith" and "Mr. Smith" agree on the surname; surrogates
  follow the script and, for given names, the gender shown by the title or the name itself.

Equal entities get equal surrogates everywhere (coreference).  Candidates are checked for
collisions: no two entities share a surrogate and no surrogate is itself an entity of the corpus;
losers draw again with the next counter.  Only entities travel, and documents without any are
neither shuffled nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashgrid.llm.common import stored

# fixed values: titles and common given names by gender (the last titles say none)
TITLES_F = ("Mrs Ms Miss Madame Mme Frau Señora Sra Signora Госпожа госпожа Г-жа г-жа Κυρία κυρία "
            "Dame Lady Mademoiselle Mlle Signorina Doña السيدة الآنسة גברת גב׳ श्रीमती सुश्री").split()
TITLES_M = ("Mr Mister Monsieur Herr Señor Sr Signor Господин господин Г-н г-н Κύριος κύριος "
            "Sir Lord Don السيد מר श्री").split()
TITLES_N = ("Dr Doctor Prof Professor Rev Reverend Judge Justice Senator Captain Colonel Доктор доктор Профессор профессор "
            "الدكتور الدكتورة الأستاذ ד״ר פרופ׳ डॉ").split()
GIVEN_F = ("Mary Anna Anne Maria Marie Emma Sophie Laura Julia Sarah Alice Elena Olga Susan Linda Karen Petra Claudia "
           "Carmen Lucia Isabel Мария Анна Елена Ольга Наталья Татьяна Μαρία Ελένη Άννα "
           "Jennifer Patricia Elizabeth Barbara Jessica Margaret Lisa Nancy Betty Sandra Ashley Kimberly Emily Donna Michelle Carol "
           "Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Katherine "
           "Catherine Christine Samantha Debra Rachel Carolyn Janet Heather Diane Julie Joyce Victoria Kelly Christina Joan Evelyn "
           "Lauren Judith Megan Andrea Cheryl Hannah Jacqueline Martha Gloria Teresa Ann Sara Madison Kathryn Janice Alicia Abigail "
           "Sophia Frances Jean-Marie Judy Isabella Julie Denise Amber Danielle Marilyn Beverly Theresa Diana Natalie Brittany "
           "Charlotte Kayla Alexis Lori Ingrid Helga Ursula Monika Sabine Birgit Katharina Camille Chloé Amélie Élodie Hélène "
           "Margaux Francesca Giulia Chiara Valentina Paola Rosa Ana Sofía María Lucía Pilar Beatriz Inés Fatima Aisha Priya "
           "Светлана Ирина Екатерина Юлия Людмила Κατερίνα Σοφία Ιωάννα").split()
GIVEN_M = ("John James Peter Paul Thomas Michael David Robert William Hans Klaus Pierre Jean Carlos Juan Pedro Luis "
           "Antonio Иван Пётр Сергей Алексей Дмитрий Андрей Γιώργος Νίκος Δημήτρης "
           "Kevin Richard Joseph Charles Christopher Daniel Matthew Anthony Steven Andrew Joshua Kenneth Brian George Timothy Ronald "
           "Jason Edward Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory "
           "Alexander Patrick Jack Dennis Jerry Tyler Aaron Jose Adam Nathan Henry Zachary Douglas Kyle Noah Ethan Jeremy "
           "Walter Keith Roger Terry Sean Gerald Carl Harold Dylan Arthur Lawrence Jordan Jesse Bryan Bruce Gabriel Logan Alan "
           "Albert Willie Vincent Philip Ralph Eugene Russell Wolfgang Jürgen Stefan Andreas Matthias Heinrich Friedrich Günther "
           "François Philippe Jacques Michel Laurent Olivier Guillaume Marco Giovanni Giuseppe Luca Francesco Alessandro José "
           "Javier Miguel Fernando Diego Pablo Ángel Mohammed Muhammad Ahmed Omar Ali Raj Rahul Михаил Александр Николай Владимир "
           "Евгений Κώστας Γιάννης Παναγιώτης").split()

# a cased name starts with a capital; Arabic, Hebrew and Devanagari know no case (marks belong to the word)
_UNICASE = r"[\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}&&[\p{L}\p{M}]]"
_NAME = rf"(?:\p{{Lu}}[\p{{L}}'’-]+|{_UNICASE}{{2,}}+)"
# Han, kana and Hangul names stand before an honorific (Han ones without spaces start with a common surname)
_HAN_FIRST = "王李张張刘劉陈陳杨楊赵趙黄黃周吴吳徐孙孫胡朱高林何郭马馬罗羅梁宋郑鄭谢謝韩韓唐冯馮于董萧程曹袁邓鄧许許傅沈曾彭吕呂苏蘇卢盧蒋蔡贾丁魏薛叶葉余潘杜戴夏"
EAST = (rf"(?:(?<!\p{{L}})\p{{IsHan}}{{1,4}}|[{_HAN_FIRST}]\p{{IsHan}}{{0,2}}?)(?=先生|女士|小姐|教授|医生|さん|さま|様|氏)"
        r"|(?<!\p{L})(?:\p{IsHiragana}{2,6}?|[\p{IsKatakana}ー]{2,8})(?=さん|さま|様|氏)|(?<!\p{L})\p{IsHangul}{2,4}?(?=\s?(?:씨|님|선생))")
CONTEXT = r"(?<=\b(?:[Mm]y name is|[Nn]ame:|[Ss]igned by|[Ww]ritten by|I am called) )"
_WORD = r"\p{L}\p{N}"
EMAIL = r"(?<![.%+-])[\p{L}\p{N}._%+-]++(?<=[\p{L}\p{N}_%+-])@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<!\.){OCTET}(?:\.{OCTET}){{3}}(?!\w|\.\d)"
_HEX4 = "[0-9A-Fa-f]{1,4}"
IPV6 = (rf"(?<!:)(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}(?::{_HEX4}){{0,6}})?::(?:{_HEX4}(?::{_HEX4}){{0,6}})?)"
        r"(?![\w:]|\.\d)")
SSN = r"(?<!-)\d{3}-\d{2}-\d{4}(?![\w-])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
PHONE = (r"(?<!\+)\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w])"
         r"|(?<!\))\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
         r"|(?<![.+-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
         r"|(?<![.+-]|\d )(?:1 )?\d{3} \d{3} \d{4}(?![\w-]| \d)"
         r"|(?<![.+-]|\d )0(?:\d{1,4}(?: \d{3,4}){2}|\d{2,4}(?:-\d{3,4}){2}|\d(?:[ .]\d{2}){4})(?![\w-]| \d)"
         r"|(?<!\+)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)")
CARD = r"(?<!\.)\d(?:[ -]?\d){12,18}(?!\w)"
PERSON = (rf"(?:{'|'.join(TITLES_F + TITLES_M + TITLES_N)})\.?\s(?:{_NAME}(?:\s\p{{Lu}}[\p{{L}}'’-]+)?)"
          rf"|(?:{'|'.join(GIVEN_F + GIVEN_M)})\s{_NAME}|{CONTEXT}{_NAME}(?:\s{_NAME})?")
# one look back keeps the search out of words, and one look ahead picks the kinds that can start here
ENTITY = (rf"(?<![{_WORD}_])(?:{EMAIL}|(?=[0-9A-Fa-f]{{0,4}}:)(?:{IPV6})|(?=[0-9+(])(?:{IP}|{SSN}|{PHONE}|{CARD})|(?=[A-Z]{{2}}[0-9])(?:{IBAN})"
          rf"|(?=[\p{{Lu}}гκдп]|{_UNICASE})(?:{PERSON}))|(?=[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsHangul}}])(?:{EAST})")

# surrogate letters per script, and syllables for names
SCRIPTS = [("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
           (r"\p{IsCyrillic}&&\p{Ll}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"\p{IsCyrillic}&&\p{Lu}", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
           (r"\p{IsGreek}&&\p{Ll}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{IsGreek}&&\p{Lu}", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
           (r"\p{IsLatin}&&\p{Ll}", "àâäçèéêëîïñóôöùûü"), (r"\p{IsLatin}&&\p{Lu}", "ÀÂÄÇÈÉÊËÎÏÑÓÔÖÙÛÜ"),
           (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
           (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてと"), (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテト"),
           (r"\p{IsHan}", "安白成德方高国海洪江金李林明平秋石天文新阳永雨志中"), (r"\p{IsHangul}", "가나다라마바사아자차카타파하"),
           (r"\p{IsDevanagari}", "अआइईउकखगघचछजटडतथदनपबमयरलवसह")]
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αειου")}
ENDINGS = {"latin": {"f": ["na", "la", "ra", "sa"], "m": ["n", "l", "r", "s"], "": ["ner", "mann", "son", "ster"]},
           "cyrillic": {"f": ["на", "ла", "ра", "са"], "m": ["н", "л", "р", "с"], "": ["нов", "лев", "рин", "ский"]},
           "greek": {"f": ["να", "λα", "ρα", "σα"], "m": ["νος", "λος", "ρος", "σος"], "": ["ιδης", "πουλος", "ακης", "ου"]}}


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def kind_of(surface: str) -> str:
    """SQL for the kind of a matched surface."""
    return f"""case when contains({surface}, '@') then 'email'
        when contains({surface}, ':') then 'ipv6'
        when {surface} rlike {_sql(r'^\p{L}{2}\d{2} ?[A-Z0-9]')} then 'iban'
        when {surface} rlike {_sql(r'^\p{L}')} then 'name'
        when {surface} rlike {_sql(r'^\d{1,3}(\.\d{1,3}){3}$')} then 'ip'
        when {surface} rlike {_sql(r'^\d{3}-\d{2}-\d{4}$')} then 'ssn'
        when {surface} rlike {_sql(r'^\d(?:[ -]?\d){12,18}$')} then 'card'
        else 'phone' end"""


def matches(text: Column) -> Column:
    """Surfaces of the entities of a text in order.  Names that a full mention introduces are also
    found where they stand alone later or earlier in the same text."""
    first = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return first


def _solo(hits: str) -> str:
    """SQL: distinct name words of the person mentions among ``hits``."""
    titles = _sql("^(?:" + "|".join(TITLES_F + TITLES_M + TITLES_N) + r")\.?$")
    return f"""array_distinct(filter(flatten(transform(filter({hits}, x -> x rlike {_sql(r'^\p{L}+\.?\s|^\p{L}-\p{L}+\.?\s')}
        and not contains(x, '@')), x -> split(x, {_sql(r'\s+')}))),
        w -> not w rlike {titles} and w rlike {_sql('^' + _NAME + '$')}))"""


def mentions(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with entities: d_id, d_key, hits (surfaces in order)."""
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64(text).alias("d_key"), text.alias("text"))
    return with_parts(base.filter(F.col("text").rlike(ENTITY)), "text").select("d_id", "d_key", "hits")


def with_parts(base: DataFrame, text: str) -> DataFrame:
    """``base`` plus hits (the surfaces of column ``text`` in order) and parts (the text around them, one
    more than hits)."""
    base = base.withColumn("hits", matches(F.col(text))).withColumn("solo", F.expr(_solo("hits")))
    more = F.concat(F.lit(ENTITY + rf"|(?<![{_WORD}])(?=[\p{{Lu}}\p{{Lo}}])(?:"),
                    F.array_join(F.transform("solo", lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|"),
                    F.lit(rf")(?![{_WORD}])"))
    plain = F.size("solo") == 0
    return base.withColumns({
        "parts": F.when(plain, F.split(text, ENTITY, -1)).otherwise(F.split(F.col(text), more, -1)),
        "hits": F.when(plain, F.col("hits")).otherwise(F.regexp_extract_all(text, more, F.lit(0)))})


def words_of_mentions(found: DataFrame) -> DataFrame:
    """d_id, d_key, i, j, kind, norm, attr, surface: one row per entity mention, one per word for
    names.  attr: for names the role seen here (3 female given name, 2 male, 1 given, 0 surname)."""
    f_title, m_title, n_title = (_sql(f"^(?:{'|'.join(t)})\\.?$") for t in (TITLES_F, TITLES_M, TITLES_N))
    f_given, m_given = (_sql(f"^(?:{'|'.join(g)})$") for g in (GIVEN_F, GIVEN_M))
    one = found.select("d_id", "d_key", F.posexplode("hits").alias("i", "surface")).distinct()
    one = one.withColumn("kind", F.expr(kind_of("surface")))
    words = F.expr(f"if(kind = 'name', split(surface, {_sql(r'(?<=\s)|(?=\s)')}), array(surface))")
    one = one.withColumn("words", words).withColumn("title", F.expr(
        f"case when kind <> 'name' then 0 when words[0] rlike {f_title} then 3 when words[0] rlike {m_title} then 2 "
        f"when words[0] rlike {n_title} and size(words) > 1 then 1 else 0 end"))
    w = one.select("d_id", "d_key", "i", "kind", "title", F.size("words").alias("n"),
                   F.posexplode("words").alias("j", "surface"))
    digits = F.regexp_replace("surface", r"\D", "")
    norm = (F.when(F.col("kind") == "phone", F.expr(f"right({'regexp_replace(surface, ' + _sql(chr(92) + 'D') + ', ' + _sql('') + ')'}, 10)"))
            .when(F.col("kind").isin("card", "ssn"), digits)
            .when(F.col("kind") == "iban", F.regexp_replace("surface", " ", ""))
            .otherwise(F.lower("surface")))
    attr = F.expr(f"""case when kind <> 'name' then 0
        when surface rlike {f_given} then 3 when surface rlike {m_given} then 2
        when title > 0 and j = 2 and n > 3 then title
        when title = 0 and j = 0 and n > 1 then 1 else 0 end""")
    blank = (F.col("kind") == "name") & ((F.col("title") > 0) & (F.col("j") == 0) | F.col("surface").rlike(r"^\s*$"))
    return w.select("d_id", "d_key", "i", "j", F.when(blank, "keep").otherwise(F.col("kind")).alias("kind"),
                    norm.alias("norm"), attr.alias("attr"), "surface")


def _pick(letters: str, at: str) -> str:
    return f"substr({_sql(letters)}, cast(pmod(xxhash64(seed, {at}), {len(letters)}) as int) + 1, 1)"


def _shape(s: str, keep: str = "false") -> str:
    """SQL: ``s`` with every letter and digit replaced by a keyed one of its script and case."""
    cases = " ".join(f"when c rlike {_sql('[' + r + ']' if not r.startswith('[') else r)} then {_pick(a, 'j')}"
                     for r, a in SCRIPTS)
    return f"array_join(transform(split({s}, ''), (c, j) -> case when {keep} then c {cases} else c end), '')"


def _luhn(digits: str) -> str:
    """SQL: Luhn sum of a digit string modulo 10."""
    d = f"cast(x as int) * (1 + pmod(i, 2))"
    return f"""pmod(aggregate(transform(split(reverse({digits}), ''), (x, i) -> if(x = '', 0,
        if({d} > 9, {d} - 9, {d}))), 0, (a, x) -> a + x), 10)"""


def _name(attr: str) -> str:
    """SQL: a pronounceable name in the script of ``norm``, with an ending of the gender in attr."""
    # every fourth attempt adds a syllable (a letter where there are none), so the names never run out
    def build(script):
        con, vow = SYLLABLES[script]
        more = f"if(attempt < 4, '', array_join(transform(sequence(1, cast(attempt div 4 as int)), k -> concat({_pick(con, '100 + k')}, {_pick(vow, '200 + k')})), ''))"
        syl = lambda k: f"{_pick(con, 10 + k)}, {_pick(vow, 20 + k)}"
        end = lambda g: f"element_at(array({', '.join(_sql(e) for e in ENDINGS[script][g])}), cast(pmod(xxhash64(seed, 30), 4) as int) + 1)"
        return (f"concat({syl(0)}, {syl(1)}, {more}, if({attr} in (2, 3), '', concat({syl(2)})), "
                f"case {attr} when 3 then {end('f')} when 2 then {end('m')} else {end('')} end)")
    return f"""case when norm rlike '\\\\p{{IsCyrillic}}' then {build('cyrillic')}
        when norm rlike '\\\\p{{IsGreek}}' then {build('greek')}
        when norm rlike '\\\\p{{IsLatin}}' then {build('latin')} else {_shape("rpad(norm, cast(length(norm) + attempt div 4 as int), norm)")} end"""


def candidate(key: str) -> Column:
    """Keyed surrogate of (kind, norm, attr) at its current attempt."""
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "norm", F.col("attempt").cast("string")), 256)
    octet = lambda k, lo, n: f"cast({lo} + pmod(xxhash64(seed, {k}), {n}) as string)"
    tail = "j >= length(norm) - instr(reverse(norm), '.')"
    card = f"""if({_luhn('norm')} = 0, transform(array(concat(left({_shape('norm')}, length(norm) - 1), '0')), b ->
        concat(left(b, length(b) - 1), cast(pmod(10 - {_luhn('b')}, 10) as string)))[0], {_shape('norm')})"""
    hexed = lambda x: f"array_join(transform(split({x}, ''), (c, j) -> case when c rlike '[0-9]' then {_pick('0123456789', 'j')} when c rlike '[a-f]' then {_pick('abcdef', 'j')} else c end), '')"
    ipv6 = f"if(attempt < 4, {hexed('norm')}, {hexed(_sql('0000:' * 7 + '0000'))})"  # a short form has few values
    body = F.expr(f"""case kind when 'ipv6' then {ipv6} when 'email' then {_shape('norm', tail)} when 'iban' then {_shape('norm', 'j < 2')}
        when 'ip' then concat_ws('.', {octet(0, 1, 223)}, {octet(1, 0, 256)}, {octet(2, 0, 256)}, {octet(3, 1, 254)})
        when 'card' then {card} when 'name' then {_name('attr')} else {_shape('norm')} end""")
    return seed, body


def surrogates(entities: DataFrame, key: str, max_rounds: int = 64) -> DataFrame:
    """kind, norm, sur: a distinct surrogate for each distinct entity (kind, norm, attr).

    Each round computes the candidates, lets the first entity (settled ones first) keep a contested
    one and moves the others, and every candidate that is itself an entity, to the next attempt.
    Raises if a format has too few values for its entities."""
    state = entities.withColumn("attempt", F.lit(0)).withColumn("settled", F.lit(False))
    known = stored(entities.select("kind", "norm"))
    for _ in range(max_rounds):
        seed, body = candidate(key)
        cand = state.withColumn("seed", seed).withColumn("sur", body).drop("seed")
        rank = F.row_number().over(Window.partitionBy("kind", "sur").orderBy(F.col("settled").desc(), "norm"))
        taken = known.select(F.col("kind").alias("k_kind"), F.col("norm").alias("k_norm"), F.lit(True).alias("taken"))
        met = cand.withColumn("rank", rank).join(
            taken, (F.col("kind") == F.col("k_kind")) & (F.col("sur") == F.col("k_norm")), "left")
        ok = F.col("settled") | ((F.col("rank") == 1) & F.col("taken").isNull())
        state = stored(met.select("kind", "norm", "attr", (F.col("attempt") + F.when(ok, 0).otherwise(1)).alias("attempt"),
                                  ok.alias("settled"), "sur"))
        if state.filter(~F.col("settled")).isEmpty():
            return state.select("kind", "norm", "sur")
        state = state.drop("sur")
    raise ValueError("an entity format has too few values for distinct surrogates")


def _pour() -> Column:
    """The surrogate written in the format of the surface: digits into its digit places (leading
    ones beyond the surrogate's length stay), letters in its case."""
    skip = "length(regexp_replace(surface, '[^0-9]', '')) - length(sur)"
    digits = f"""aggregate(split(surface, ''), struct('' as o, 0 as k), (a, c) -> if(c rlike '[0-9]',
        struct(concat(a.o, if(a.k >= {skip}, substr(sur, a.k - ({skip}) + 1, 1), c)) as o, a.k + 1 as k),
        struct(concat(a.o, c) as o, a.k as k)), a -> a.o)"""
    letters = """if(length(surface) = length(sur), array_join(zip_with(split(surface, ''), split(sur, ''),
        (c, s) -> if(c = upper(c) and c <> lower(c), upper(s), s)), ''), sur)"""
    spaced = """aggregate(split(surface, ''), struct('' as o, 0 as k), (a, c) -> if(c = ' ',
        struct(concat(a.o, c) as o, a.k as k), struct(concat(a.o, substr(sur, a.k + 1, 1)) as o, a.k + 1 as k)), a -> a.o)"""
    named = "if(surface = upper(surface) and length(surface) > 1, upper(sur), concat(upper(left(sur, 1)), substr(sur, 2)))"
    return F.expr(f"""case kind when 'keep' then surface when 'ip' then sur when 'email' then {letters} when 'ipv6' then {letters}
        when 'iban' then {spaced} when 'name' then {named} else {digits} end""")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with surrogates), n_entities, kinds for every row of ``docs``.

    ``kinds`` lists the kinds found as kind:count, sorted.  A null text stays null and, like an empty
    one, has no entities.  Repeated rows are rewritten alike; an empty table gives no rows; other
    columns are ignored.  The same ``key`` always gives the same surrogates for the same corpus."""
    found = mentions(docs)
    words = stored(words_of_mentions(found))
    entities = words.filter("kind <> 'keep'").groupBy("kind", "norm").agg(F.max("attr").alias("attr"))
    table = surrogates(entities, key)
    placed = words.join(table, ["kind", "norm"], "left").select("d_id", "d_key", "i", "j", "kind", _pour().alias("new"))
    whole = placed.groupBy("d_id", "d_key", "i").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "new"))), lambda x: x["new"]), "").alias("new"),
        F.max(F.when(F.col("kind") != "keep", F.col("kind"))).alias("kind"))
    per = whole.groupBy(F.col("d_id").alias("h_id"), F.col("d_key").alias("h_key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias("news"),
        F.array_sort(F.collect_list("kind")).alias("kinds"))
    same = F.col("d_id").eqNullSafe(F.col("h_id")) & (F.col("d_key") == F.col("h_key"))
    kinds = F.array_join(F.transform(F.array_distinct("kinds"), lambda k: F.concat(
        k, F.lit(":"), F.size(F.filter("kinds", lambda x: x == k)).cast("string"))), ",")
    pieces = F.transform("parts", lambda p, i: F.concat(p, F.coalesce(F.get("news", i), F.lit(""))))
    # only documents with entities are matched again; the others pass through the join as they are
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64(text).alias("d_key"), text.alias("text"))
    met = with_parts(base.join(per, same, "left").withColumn("text_", F.when(F.col("news").isNotNull(), F.col("text"))), "text_")
    hit = F.col("news").isNotNull()
    return met.select(F.col("d_id").alias("doc_id"), F.when(hit, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"),
                      F.when(hit, F.size("hits")).otherwise(F.lit(0)).cast("long").alias("n_entities"),
                      F.when(hit, kinds).otherwise(F.lit("")).alias("kinds"))
