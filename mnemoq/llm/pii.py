"""PII (native): format-preserving Feistel pseudonyms. Numbers that pass their kind's validation, and
dates, are permuted under a key within their own format, so equal values stay equal, and linked,
across documents, whatever separators they are written with.

Only DataFrame functions run, row by row: a text is split at a kind's pattern, its matches are
transformed and the parts joined again. Nothing is shuffled. The round function is SHA-256 under the
key; a round adds it to one half modulo that half's range, so each network is a permutation of its
domain, and values that must pass a validation are walked along the permutation until they do.

Kinds: payment cards (16 digits, or 15 from 34 or 37 on, that pass the Luhn check; the pseudonym passes it,
too, and 15 digits keep their first two), social security numbers, telephone numbers (validated by their
form alone), IPv4 addresses, ISO dates 1900-2099, and, as keyed tokens of the same form rather than
permutations, the names of mail addresses and hexadecimal secrets. Numbers that fail the validation
stay as they are. All kinds are found in one pass over the original text, so no pseudonym is permuted
again; where two kinds begin at one place, mail comes first, then the order above. A walk ends after 64 steps: less than one value
in 10**60 would need more, and would keep the last one, still in its format.

Defined cases: null text stays null with zero counts; texts without matches are unchanged; very long texts are
one row's work, none is cut; repeated rows each get their own result; an empty table gives no rows; extra
columns pass through ``pseudonymise``; columns with the names of the counts are replaced; those with the
prefix ``_pi_`` are made here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERY_KEY = "of the registered query"  # a test's key: the operator itself has no default
ROUNDS = 8

CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[0-9]{12}|(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})|3[47][0-9]{2}(?:[0-9]{11}| [0-9]{6} [0-9]{5}|-[0-9]{6}-[0-9]{5}))(?![0-9A-Za-z])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?:(?<![0-9])\+[0-9]{1,3}[ -]?)(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9(+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])"
DATE = r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])"
MAIL = r"(?<![\w.+-])[A-Za-z0-9_+\p{L}](?:[A-Za-z0-9._+\p{L}-]*[A-Za-z0-9_+\p{L}])?(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prf(key: str, tag: str, *args: str) -> str:
    return f"cast(conv(substr(sha2(concat_ws('|', {_text(key)}, '{tag}', {', '.join(f'cast({a} as string)' for a in args)}), 256), 1, 15), 16, 10) as bigint)"


def feistel(x: str, left: int, right: int, key: str, tag: str) -> str:
    """SQL for a keyed permutation of 0 .. left * right - 1 (both at most 2**32), applied to x."""
    even = f"struct(pmod(s.a + {_prf(key, tag, 'r', 's.b')}, {left}L) as a, s.b as b)"
    odd = f"struct(s.a as a, pmod(s.b + {_prf(key, tag, 'r', 's.a')}, {right}L) as b)"
    return f"aggregate(sequence(1, {ROUNDS}), struct(({x}) div {right}L as a, ({x}) % {right}L as b), (s, r) -> if(r % 2 = 0, {even}, {odd}), s -> s.a * {right}L + s.b)"


def walk(x: str, left: int, right: int, valid: str, key: str, tag: str, most: int = 64) -> str:
    """The permutation again and again until `valid` (SQL on y) holds: a permutation of the valid values."""
    return f"aggregate(sequence(1, {most}), {feistel(x, left, right, key, tag)}, (y, k) -> if({valid}, y, {feistel('y', left, right, key, tag)}))"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(m: str, digits: str) -> str:
    """The match with its digits replaced, one by one, by those given; all else stays."""
    return (f"aggregate(split({m}, ''), struct({digits} as d, '' as o), (s, c) -> if(c rlike '[0-9]', struct(substr(s.d, 2) as d, concat(s.o, left(s.d, 1)) as o), struct(s.d as d, concat(s.o, c) as o)), s -> s.o)")


def luhn(d: str) -> str:
    """SQL: the Luhn sum of a string of digits whose last one is the check digit."""
    return f"aggregate(sequence(1, length({d})), 0, (t, i) -> t + element_at(if(i % 2 = 0, array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9)), 1 + cast(substr({d}, length({d}) + 1 - i, 1) as int)))"


def _kinds(key: str) -> list[tuple[str, str, str, str]]:
    """(count's name, pattern, SQL of a pseudonym for the match m, SQL that validates m), in order of precedence."""
    d = _digits("m")
    check = "concat(p, cast((10 - " + luhn("concat(p, '0')") + " % 10) % 10 as string))"
    payload = f"lpad(cast({feistel(f'cast(left({d}, 15) as bigint)', 10**8, 10**7, key, 'card')} as string), 15, '0')"
    short = f"concat(left({d}, 2), lpad(cast({feistel(f'cast(substr({d}, 3, 12) as bigint)', 10**6, 10**6, key, 'card15')} as string), 12, '0'))"
    card = _refill("m", f"element_at(transform(array(if(length({d}) = 16, {payload}, {short})), p -> {check}), 1)")
    ssn_ok = "y < 900000000 and y div 1000000 not in (0, 666) and (y div 10000) % 100 > 0 and y % 10000 > 0"
    ssn = _refill("m", f"lpad(cast({walk(f'cast({d} as bigint)', 10**5, 10**4, ssn_ok, key, 'ssn')} as string), 9, '0')")
    phone = _refill("m", f"concat(left({d}, length({d}) - 10), lpad(cast({feistel(f'cast(right({d}, 10) as bigint)', 10**5, 10**5, key, 'phone')} as string), 10, '0'))")
    ip = feistel("aggregate(split(m, '[.]'), 0L, (t, o) -> t * 256 + cast(o as bigint))", 65536, 65536, key, "ip")
    ip = f"element_at(transform(array({ip}), v -> concat_ws('.', v div 16777216, (v div 65536) % 256, (v div 256) % 256, v % 256)), 1)"
    days = 73_049
    date = f"cast(date_add(date'1900-01-01', cast({walk('cast(datediff(try_to_date(m), date' + chr(39) + '1900-01-01' + chr(39) + ') as bigint)', 271, 270, f'y < {days}', key, 'date')} as int)) as string)"
    mail = f"concat('user', lpad(cast(pmod({_prf(key, 'mail', 'lower(m)')}, 1000000000000L) as string), 12, '0'))"
    secret = f"left(sha2(concat_ws('|', {_text(key)}, 'secret', lower(m)), 256), length(m))"
    return [
        ("n_mails", MAIL, mail, "true"),
        ("n_cards", CARD, card, f"{luhn(d)} % 10 = 0"),
        ("n_ssns", SSN, ssn, ssn_ok.replace("y", f"cast({d} as bigint)")),
        ("n_phones", PHONE, phone, "true"),
        ("n_ips", IPV4, ip, "true"),
        ("n_dates", DATE, date, "try_to_date(m) is not null"),
        ("n_secrets", SECRET, secret, "true"),
    ]


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with text pseudonymised, and a count of what was replaced for each kind."""
    if not key:
        raise ValueError("a key is needed")
    kinds = _kinds(key)
    every = _text("|".join(f"({pattern})" for _, pattern, *_ in kinds))  # the patterns hold no groups of their own
    none = "cast(array() as array<string>)"
    groups = ", ".join(f"regexp_extract_all(text, {every}, {i + 1})" for i in range(len(kinds)))
    which = "case " + " ".join(f"when element_at(z, {i + 1}) <> '' then {i}" for i in range(len(kinds))) + " end"
    valid = "case k " + " ".join(f"when {i} then if({ok}, {i}, -1)" for i, (*_, ok) in enumerate(kinds)) + " end"
    as_ = "case k " + " ".join(f"when {i} then {pseudonym}" for i, (_, _, pseudonym, _) in enumerate(kinds)) + " else m end"
    d = docs.drop(*[name for name, *_ in kinds])
    d = d.withColumn("_pi_m", F.expr(f"if(text rlike {every}, regexp_extract_all(text, {every}, 0), {none})"))
    d = d.withColumn("_pi_g", F.expr(f"if(size(_pi_m) > 0, array({groups}), array({none}))"))
    d = d.withColumn("_pi_k", F.expr(f"transform(transform(_pi_m, (m, j) -> transform(_pi_g, g -> get(g, j))), z -> {which})"))
    d = d.withColumn("_pi_k", F.expr(f"zip_with(_pi_m, _pi_k, (m, k) -> {valid})"))
    d = d.withColumn("_pi_o", F.expr(f"zip_with(_pi_m, _pi_k, (m, k) -> {as_})"))
    join = f"array_join(zip_with(split(text, {every}, -1), concat(_pi_o, array('')), (a, b) -> concat(a, b)), '')"
    d = d.withColumns({"text": F.expr(f"if(size(_pi_m) = 0, text, {join})"), **{name: F.expr(f"cast(size(filter(_pi_k, k -> k = {i})) as bigint)") for i, (name, *_) in enumerate(kinds)}})
    return d.drop("_pi_m", "_pi_g", "_pi_k", "_pi_o")


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
