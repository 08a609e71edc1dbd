"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent. DataFrame expressions only.

Found: e-mail addresses, telephone numbers (international, of ten digits in groups, or with a
trunk zero; bare digits are no number), IPv4 and IPv6 addresses, social security numbers,
payment cards (with a valid check digit), bank account numbers (IBAN with a valid check), names
after an honorific (also in capitals, with an apostrophe, particles or initials), and the same
names wherever else the document has them, unless it has the word in small letters, too. A
found entity is taken apart into tokens with a kind: the local part and the domain of an
address, the digits of a number, given and family names with the gender of the honorific.
Particles and initials stay. A token's surrogate is drawn from a keyed hash of its kind and value:

- letters become letters of the same script and case, digits digits; separators stay;
- a telephone number keeps its country code (a national one begins its groups with 2 to 9), a
  card its length and a valid check digit, an account number its country and valid check digits,
  an IPv6 address its first group, its zeros and the way it is shortened;
- domains lie under reserved example domains;
- Latin, Cyrillic and Greek names are made of syllables of their script, with an ending of
  their gender; names in other scripts with capitals get other letters of their script.

The caller gives the key; whoever has it can draw the same surrogates again.

So the same token has the same surrogate in all documents, in whatever format it is written:
numbers of country code 1 go by their national digits (a number with a trunk zero names no
country, so it is a token of its own), addresses by their small letters and whole groups, and a name found with different
honorifics has one gender (female before male before neutral).
All distinct tokens of the corpus are then checked: two tokens of a kind with one surrogate,
or a surrogate that is itself a real token, are drawn again (with longer words from the
fourth draw on) until every surrogate is distinct and new.

Defined results: a null text stays null, an empty one empty, with no entities; texts without
entities pass unchanged and are not shuffled; invalid cards and numbers are left alone; very
long texts are whole; repeated rows get a row each; doc_id may be null; an empty table gives
no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import stored, written

MOST_DRAWS = 40

#: Honorifics by gender.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин", "κύριος", "κύριο", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Signora", "г-жа", "госпожа", "κυρία", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Mx")

_L, _N = r"\p{L}", r"\p{N}"
EMAIL = rf"(?<![{_L}{_N}._%+-])[{_L}{_N}._%+-]{{1,64}}+@[{_L}{_N}][{_L}{_N}-]{{0,62}}(?:\.[{_L}{_N}-]{{1,63}})*\.{_L}{{2,24}}(?![{_L}{_N}])"
PHONE = rf"(?<![{_L}\d])\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .-]?\d{{2,4}}){{2,4}}(?!\d)|(?<![{_L}\d])\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d)|(?<![\d-])\d{{3}}-\d{{3}}-\d{{4}}(?![\d-])|(?<![\d.])[2-9]\d{{2}}\.\d{{3}}\.\d{{4}}(?!\.?\d)|(?<![{_L}\d.,+-])(?<!\d )0\d{{2,4}} \d{{3,4}} \d{{3,4}}(?! ?\d)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
SSN = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![\p{{L}}\p{{N}}:.])(?:{_HEX}(?::{_HEX}){{7}}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}|(?:[Ff][Ee]80|[23][0-9A-Fa-f]{{3}}|[Ff][CcDd][0-9A-Fa-f]{{2}}):(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])"
CARD = rf"(?<![{_L}\d])\d(?:[ -]?\d){{12,18}}(?![{_L}\d])"
#: Honorifics in capitals (those that are common abbreviations need a dot), particles and prefixes of names.
CAPITAL_TITLES = r"MRS?\.?|(?:MS|DR|PROF)\."
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "ten", "ter", "zu", "bin", "ibn", "al")
_PREFIX = "[ODL]['’]"
_WORD = rf"(?:{_PREFIX})?(?:\p{{Lu}}\p{{Ll}}+(?:\p{{Lu}}\p{{Ll}}+)?|\p{{Lu}}{{2,}})(?!{_L})"
_PARTS = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}"
_TITLE = rf"(?:(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.?|{CAPITAL_TITLES})"
NAME = rf"(?<!{_L}){_TITLE} (?:\p{{Lu}}\. ?){{0,3}}{_PARTS}{_WORD}(?: \p{{Lu}}\.(?= \p{{Lu}}))?(?:[ -]{_PARTS}{_WORD}){{0,2}}"
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, IBAN, IPV6, PHONE, IPV4, SSN, CARD, NAME))
#: What any entity must have, an honorific or a sign: looks that are cheap enough for every text.
_SIGN = r"[@0-9]|[A-Fa-f]:[A-Fa-f:]"
_SHORT = MALE + FEMALE + NEUTRAL + ("MR", "MS.", "DR.", "PROF.")
_TITLES = [t for t in _SHORT if not any(t != o and o in t for o in _SHORT)]
_TITLED = rf"{_TITLE} [\p{{Lu}}{''.join(sorted({p[0] for p in PARTICLES}))}]"

#: Telephone country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGIT_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Alphabets, syllables and endings by script.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՒՓՔՕՖ", "àáâäçèéêëìíîïñòóôöùúûü", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ")
SYLLABLES = {"latin": "ba be bo da de di fa fe ga ge ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti to va ve vi".split(), "cyrillic": "ба бе бо ва ве ви га го да де ди за зо ка ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се си та те ти то".split(), "greek": "βα βε βο γα γε δα δε δι θε κα κε κο λα λε λι λο μα με μι να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φι χα".split()}
ENDINGS = {"latin": {"given_m": "n rd s k l".split(), "given_f": "na lia nelle rine ssa".split(), "given_n": "y lle x ris ne".split(), "family": "rson ller mann rley tte".split(), "family_f": "rson ller mann rley tte".split()}, "cyrillic": {"given_m": "н слав мир л р".split(), "given_f": "на лия ра са ма".split(), "given_n": "ша ня ля ся ти".split(), "family": "нов рин лев ков тин".split(), "family_f": "нова рина лева кова тина".split()}, "greek": {"given_m": "ρης νος λης μος κος".split(), "given_f": "να ρα λια νη σσα".split(), "given_n": "λι ρι νι κι σι".split(), "family": "πουλος ίδης άκης έας ιάδης".split(), "family_f": "πούλου ίδου άκη έα ιάδου".split()}}
_UPPER = r"\p{Lu}"
_KINDS = "array<struct<kind:string,value:string,shape:string>>"


def _array(words) -> str:
    return "array(" + ",".join(f"'{w}'" for w in words) + ")"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a string of digits, modulo 10."""
    d = f"cast(substring({digits}, length({digits}) - u, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, u) -> s + if(u % 2 = 0, {d}, if({d} > 4, {d} * 2 - 9, {d} * 2))) % 10"


def _mod97(text: str) -> str:
    """SQL: capitals and digits read as a number, A as 10, modulo 97."""
    return f"aggregate(transform(sequence(1, length({text})), j -> substring({text}, j, 1)), 0, (n, c) -> if(c between '0' and '9', (n * 10 + cast(c as int)) % 97, (n * 100 + ascii(c) - 55) % 97))"


def _draw(key: str) -> str:
    """SQL: 256 hexadecimal digits of the keyed hash of kind, value and draw."""
    return "concat(" + ",".join(f"sha2(concat_ws('\\u0001', {_quoted(key)}, kind, value, cast(draw as string), '{part}'), 256)" for part in "abcd") + ")"


def _number(i: str) -> str:
    return f"cast(conv(substring(drawn, 1 + 3 * (({i}) % 84), 3), 16, 10) as int)"


def _letters(text: str) -> str:
    """SQL: each letter and digit of a text replaced within its alphabet."""
    c = f"substring({text}, i + 1, 1)"
    cases = [f"when {c} between '0' and '9' then cast({_number('i')} % 10 as string)"]
    cases += [f"when instr('{a}', {c}) > 0 then substring('{a}', {_number('i')} % {len(a)} + 1, 1)" for a in ALPHABETS]
    cases.append(f"when {c} rlike '\\\\p{{L}}' then substring('{ALPHABETS[0]}', {_number('i')} % 26 + 1, 1)")
    return f"if(length({text}) = 0, '', array_join(transform(sequence(0, length({text}) - 1), i -> case {' '.join(cases)} else {c} end), ''))"


def _digits(start: str, count: str) -> str:
    return f"if({count} <= 0, '', array_join(transform(sequence(0, greatest({count}, 1) - 1), i -> cast({_number(f'i + {start}')} % 10 as string)), ''))"


def _name(script: str) -> str:
    s = SYLLABLES[script]
    count = "(2 + if(draw > 3, draw - 3, 0))"
    stem = f"array_join(transform(sequence(1, {count}), i -> element_at({_array(s)}, {_number('i')} % {len(s)} + 1)), '')"
    cases = " ".join(f"when '{k}' then element_at({_array(e)}, {_number('0')} % {len(e)} + 1)" for k, e in ENDINGS[script].items())
    return f"initcap(concat({stem}, case kind {cases} end))"


def surrogate(key: str) -> Column:
    """The surrogate of a token (columns kind, value, draw, drawn)."""
    extra = f"if(draw > 3, array_join(transform(sequence(1, draw - 3), i -> substring('{ALPHABETS[0]}', {_number('i + 70')} % 26 + 1, 1)), ''), '')"
    host = "substring_index(value, '.', 1)"
    two = ", ".join(f"'{c}'" for c in TWO_DIGIT_CODES)
    kept = f"case when substring(value, 1, 1) in ('1', '7') then 1 when substring(value, 1, 2) in ({two}) then 2 else 3 end"
    account = _letters("substring(value, 5)")
    country = "substring(value, 1, 2)"
    # letters stay letters and digits digits; from the fourth draw on, groups are as long as they can be
    sign = lambda j, least: f"case when draw > 3 then substring('0123456789abcdef', {least} + 1 + {_number(f'4 * k + {j}')} % (16 - {least}), 1) when substring(g, {j + 1}, 1) = '' then '' when substring(g, {j + 1}, 1) >= 'a' then substring('abcdef', 1 + {_number(f'4 * k + {j}')} % 6, 1) else cast({least} + {_number(f'4 * k + {j}')} % (10 - {least}) as string) end"
    group = f"concat({sign(0, 1)}, {sign(1, 0)}, {sign(2, 0)}, {sign(3, 0)})"
    hexes = f"array_join(transform(split(value, ':'), (g, k) -> if(k = 0 or g = '0', g, {group})), ':')"
    exchange = lambda i: f"cast(2 + {_number(i)} % 8 as string)"
    body = f"concat(substring(value, 1, 1), {_digits('0', 'length(value) - 2')})"
    first = f"cast(100 + {_number('0')} % 566 as string)"
    return F.expr(
        f"""case kind
        when 'local' then concat({_letters('value')}, {extra})
        when 'domain' then concat({_letters(host)}, {extra}, element_at(array('.example.com', '.example.net', '.example.org'), {_number('80')} % 3 + 1))
        when 'phone' then concat(substring(value, 1, {kept}), {_digits('0', f'length(value) - {kept}')})
        when 'national' then concat({exchange('0')}, {_digits('1', '2')}, {exchange('3')}, {_digits('4', 'length(value) - 4')})
        when 'trunk' then concat('0', cast(1 + {_number('0')} % 9 as string), {_digits('1', 'length(value) - 2')})
        when 'ip' then concat_ws('.', cast(1 + {_number('0')} % 223 as string), cast({_number('1')} % 256 as string), cast({_number('2')} % 256 as string), cast(1 + {_number('3')} % 254 as string))
        when 'ssn' then concat({first}, lpad(cast(1 + {_number('1')} % 99 as string), 2, '0'), lpad(cast(1 + (4096 * {_number('2')} + {_number('3')}) % 9999 as string), 4, '0'))
        when 'card' then concat({body}, cast((10 - {_luhn(f"concat({body}, '0')")}) % 10 as string))
        when 'iban' then concat({country}, lpad(cast(98 - {_mod97(f"concat({account}, {country}, '00')")} as string), 2, '0'), {account})
        when 'ip6' then {hexes}
        else case when value rlike '^[\\\\u0400-\\\\u04ff]' then {_name('cyrillic')} when value rlike '^[\\\\u0370-\\\\u03ff\\\\u1f00-\\\\u1fff]' then {_name('greek')}
            when value rlike '^[\\\\u0000-\\\\u024f]' then {_name('latin')} else concat({_letters('value')}, if(draw > 3, {_letters("substring(value, 2)")}, '')) end end"""
    )


def _whole_ip6(match: str) -> str:
    """SQL: all eight groups of an address, in lower case and without leading zeros."""
    groups = lambda at: f"filter(split(substring_index(lower({match}), '::', {at}), ':'), g -> g <> '')"
    zeros = f"array_repeat('0', 8 - size({groups(1)}) - size({groups(-1)}))"
    every = f"if(instr({match}, '::') > 0, concat({groups(1)}, {zeros}, {groups(-1)}), split(lower({match}), ':'))"
    return f"array_join(transform({every}, g -> regexp_replace(g, '^0+(?=.)', '')), ':')"


def _one_case(word: str) -> str:
    """SQL: a name in capitals with small letters; others as they are."""
    return f"if(length({word}) > 1 and {word} = upper({word}) and {word} <> lower({word}), initcap({word}), {word})"


def parts_of(match: str) -> str:
    """SQL: what a match consists of; kind null is text that stays, shape is the format to put digits into."""
    part = lambda kind, value, shape="null": f"named_struct('kind', {kind}, 'value', {value}, 'shape', {shape})"
    plain = rf"regexp_replace({match}, '[^0-9]', '')"
    local, domain = f"substring_index({match}, '@', 1)", f"substring_index({match}, '@', -1)"
    solid = f"replace({match}, ' ', '')"
    keep = f"cast(array({part('cast(null as string)', match)}) as {_KINDS})"
    code = f"regexp_extract({match}, '^[+]1[ .-]?', 0)"
    words = f"regexp_extract_all({match}, {_quoted(rf'[ -]|{_PREFIX}(?={_UPPER})|{_UPPER}[.]|[^ -]+')}, 0)"
    titles = lambda names: f"{match} rlike '^(?:{'|'.join(names)})\\\\.? '"
    # the honorific г-н / г-жа holds a hyphen: it is two words and a hyphen before the first blank
    blank = f"array_position({words}, ' ')"
    word = f"element_at({words}, w)"
    gender = f"case when {titles((*MALE, 'MR'))} then 'm' when {titles((*FEMALE, 'MRS', 'MS'))} then 'f' else 'n' end"
    stays = f"{word} in (' ', '-') or {word} in ({', '.join(repr(p) for p in PARTICLES)}) or {word} rlike {_quoted(rf'^(?:{_PREFIX}|{_UPPER}[.])$')}"
    kind = f"case when w <= {blank} or {stays} then null when w = size({words}) then if({gender} = 'f' and {word} rlike '^[\\\\u0400-\\\\u04ff]', 'family_f', 'family') else concat('given_', {gender}) end"
    return f"""case
        when instr({match}, '@') > 0 then array({part("'local'", f"lower({local})", local)}, {part('cast(null as string)', "'@'")}, {part("'domain'", f"lower({domain})", domain)})
        when {match} rlike '^[0-9A-Fa-f]*:' then array({part("'ip6'", _whole_ip6(match), match)})
        when {match} rlike '^\\\\+1' and length({plain}) = 11 then array({part('cast(null as string)', code)}, {part("'national'", f"substring({plain}, 2)", f"substring({match}, length({code}) + 1)")})
        when {match} rlike '^\\\\+' then array({part("'phone'", plain, match)})
        when {match} rlike '^(?:[0-9]{{1,3}}\\\\.){{3}}[0-9]{{1,3}}$' then array({part("'ip'", match)})
        when {match} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then array({part("'ssn'", plain, match)})
        when {match} rlike '^0[0-9]{{2,4}} [0-9]' and length({plain}) < 14 then array({part("'trunk'", plain, match)})
        when {match} rlike '^[0-9(]' and length({plain}) = 10 then array({part("'national'", plain, match)})
        when {match} rlike '^[A-Z]{{2}}[0-9]{{2}}' then if({_mod97(f"concat(substring({solid}, 5), substring({solid}, 1, 4))")} = 1, array({part("'iban'", solid, match)}), {keep})
        when {match} rlike '^[0-9]' then if({_luhn(plain)} = 0, array({part("'card'", plain, match)}), {keep})
        else transform(sequence(1, size({words})), w -> {part(kind, f"if({kind} is null, {word}, {_one_case(word)})", f"if({kind} is null, null, {word})")}) end"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_parts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and its parts: texts between entities and the tokens of entities, in order."""
    found = docs.select("doc_id", "text", F.expr(f"regexp_extract_all(text, {_quoted(ENTITY)}, 0)").alias("found"), F.expr(f"split(text, {_quoted(ENTITY)}, -1)").alias("gaps"))
    gap = f"cast(array(named_struct('kind', null, 'value', element_at(gaps, i), 'shape', null)) as {_KINDS})"
    inner = f"cast({parts_of('element_at(found, i - 1)')} as {_KINDS})"
    made = found.select("doc_id", "text", F.expr(f"flatten(transform(sequence(1, size(gaps)), i -> if(i = 1, {gap}, concat({inner}, {gap}))))").alias("parts"))
    # names found are looked for in the texts between entities, too
    made = made.withColumn("names", F.expr("array_distinct(transform(filter(parts, p -> p.kind like 'given%' or p.kind like 'family%'), p -> named_struct('value', p.value, 'kind', p.kind)))"))
    # but for those that the document also has as common words
    spelt = lambda values: rf"concat('(?<!\\p{{L}})(?:', array_join({values}, '|'), ')(?!\\p{{L}})')"
    made = made.withColumn("common", F.expr(f"if(size(names) > 0, array_distinct(regexp_extract_all(text, {spelt('array_distinct(transform(names, n -> lower(n.value)))')}, 0)), null)"))
    made = made.withColumn("names", F.expr("if(size(common) > 0, filter(names, n -> lower(n.value) = n.value or not array_contains(common, lower(n.value))), names)"))
    made = made.withColumn("bare", F.expr(f"if(size(names) > 0, {spelt('array_distinct(concat(names.value, transform(names, n -> upper(n.value))))')}, null)"))
    rest = f"cast(array(named_struct('kind', null, 'value', element_at(s.gaps, k), 'shape', null)) as {_KINDS})"
    name = "element_at(s.found, k - 1)"
    own = f"element_at(filter(names, n -> n.value = {name} or upper(n.value) = {name}), 1)"
    named = f"cast(array(named_struct('kind', {own}.kind, 'value', {own}.value, 'shape', {name})) as {_KINDS})"
    # an array of one holds what is cut once for all places
    cut = "array(named_struct('gaps', split(p.value, bare, -1), 'found', regexp_extract_all(p.value, bare, 0)))"
    split = f"flatten(flatten(transform({cut}, s -> transform(sequence(1, size(s.gaps)), k -> if(k = 1, {rest}, concat({named}, {rest}))))))"
    return made.select("doc_id", "text", F.expr(f"if(bare is null, parts, flatten(transform(parts, p -> if(p.kind is null and p.value rlike bare, {split}, array(p)))))").alias("parts"))


def _group() -> Column:
    """The kind of a token without its gender."""
    return F.regexp_replace("kind", "_[mfn]$", "")


def distinct_surrogates(tokens: DataFrame, key: str) -> DataFrame:
    """(family of kinds, value, surrogate) of all tokens (kind, value), distinct within it and none a real token; a name's gender is chosen once."""
    one = F.when(F.col("group") == "family", F.max("kind")).otherwise(F.min("kind"))
    real = stored(tokens.withColumn("group", _group()).groupBy("group", "value").agg(one.alias("kind")))
    done, waiting = None, real.withColumn("draw", F.lit(0))
    for draw in range(MOST_DRAWS):
        drawn = stored(waiting.withColumn("drawn", F.expr(_draw(key))).withColumn("surrogate", surrogate(key)).select("group", "kind", "value", "surrogate"))
        first = drawn.groupBy("group", "surrogate").agg(F.min("value").alias("value"))
        first = first.join(real.select("group", F.col("value").alias("surrogate")), ["group", "surrogate"], "left_anti")
        if done is not None:
            first = first.join(done.select("group", "surrogate"), ["group", "surrogate"], "left_anti")
        won = written(first.select("group", "value", "surrogate"), "surrogates", compact=True)
        waiting = drawn.select("group", "kind", "value").join(won.select("group", "value"), ["group", "value"], "left_anti")
        waiting = written(waiting.withColumn("draw", F.lit(draw + 1)), "waiting", compact=True)
        done = won if done is None else done.unionByName(won)
        if waiting.isEmpty():
            return done
    raise RuntimeError(f"surrogates still collide after {MOST_DRAWS} draws")


def in_shape(signs: str, shape: str) -> str:
    """SQL: digits and capitals put into the places of those of a shape."""
    return f"array_join(transform(sequence(1, length({shape})), i -> if(substring({shape}, i, 1) rlike '[0-9A-Z]', substring({signs}, length(regexp_replace(substring({shape}, 1, i), '[^0-9A-Z]', '')), 1), substring({shape}, i, 1))), '')"


def in_case(text: str, shape: str, size: str) -> str:
    """SQL: capitals where the first ``size`` characters of a shape have them; all of them if the shape has no small letter."""
    c = f"substring({shape}, i, 1)"
    each = f"concat(array_join(transform(sequence(1, greatest({size}, 1)), i -> if({c} <> lower({c}), upper(substring({text}, i, 1)), substring({text}, i, 1))), ''), substring({text}, {size} + 1))"
    return f"case when {shape} = lower({shape}) then {text} when {shape} = upper({shape}) then upper({text}) else {each} end"


def ip6_in_shape(text: str, shape: str) -> str:
    """SQL: the eight groups as the shape writes them: shortened, with leading zeros, in capitals."""
    groups = f"split({text}, ':')"
    before = f"(size(split({shape}, ':')) - i)"  # groups from here to the end
    at = f"if(instr({shape}, '::') > 0 and i > size(split(substring_index({shape}, '::', 1), ':')), 9 - {before}, i + 1)"
    put = f"array_join(transform(split({shape}, ':'), (g, i) -> if(g = '', '', lpad(element_at({groups}, {at}), greatest(length(g), length(element_at({groups}, {at}))), '0'))), ':')"
    return f"if({shape} <> lower({shape}), upper({put}), {put})"


def _as_found() -> str:
    """SQL: the surrogate of a token in the format in which it was found."""
    whole = "case when length(shape) > 1 and shape = upper(shape) and shape <> lower(shape) then upper(surrogate) else surrogate end"
    return f"""case when shape is null then surrogate
        when kind = 'local' then {in_case('surrogate', 'shape', 'length(shape)')}
        when kind = 'domain' then {in_case('surrogate', 'shape', "(instr(shape, '.') - 1)")}
        when kind = 'ip6' then {ip6_in_shape('surrogate', 'shape')}
        when kind like 'given%' or kind like 'family%' then {whole}
        else {in_shape('surrogate', 'shape')} end"""


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with every entity replaced, n_entities (tokens replaced); ``key`` is the caller's secret."""
    if not key:
        raise ValueError("surrogates need a key")
    docs = docs.select("doc_id", "text")
    titled = reduce(or_, (F.col("text").contains(t) for t in _TITLES)) & F.col("text").rlike(_TITLED)
    has = F.coalesce(F.when(F.col("text").rlike(_SIGN) | titled, F.col("text").rlike(ENTITY)), F.lit(False))
    some = stored(with_parts(docs.where(has)).select("doc_id", F.xxhash64("text", F.length("text")).alias("h"), "parts"))
    tokens = some.select("doc_id", "h", F.posexplode("parts").alias("at", "part")).where("part.kind is not null").select("doc_id", "h", "at", "part.*")
    known = distinct_surrogates(tokens.select("kind", "value"), key)
    put = tokens.withColumn("group", _group()).join(known, ["group", "value"]).select("doc_id", "h", "at", F.expr(_as_found()).alias("new"))
    put = put.groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", "new")).alias("new")).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "new")
    joined = some.join(put, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    stays = "filter(transform(parts, (p, i) -> named_struct('at', i, 'new', if(p.kind is null, p.value, null))), x -> x.new is not null)"
    text = F.expr(f"array_join(sort_array(if(new is null, {stays}, concat({stays}, new))).new, '')")
    changed = joined.select("doc_id", text.alias("text"), F.coalesce(F.expr("cardinality(new)"), F.lit(0)).cast("bigint").alias("n_entities"))
    return changed.unionByName(docs.where(~has).withColumn("n_entities", F.lit(0).cast("bigint")))
