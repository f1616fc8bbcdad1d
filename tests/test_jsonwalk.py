import hashlib
import hmac
import json
import random
import re
import sys

from pyspark.sql import functions as F

from watchfold.functions import ids, jsonwalk as J

KEY = b"a key of the tests"
DENIED = ["token", "owner"]
ESCAPED = '{"\\u0074oken":1,"a":2,"x\\"token":3,"ow\\u006eer":{"b":[1]},"c\\\\":4}'


def brute_dropped(v):
    if isinstance(v, dict):
        return {k: brute_dropped(x) for k, x in v.items() if k not in DENIED}
    return [brute_dropped(x) for x in v] if isinstance(v, list) else v


def token(prefix, value):
    if value.upper() in ("", "UNKNOWN", "NONE"):
        return value
    return f"{prefix}-{hmac.new(KEY, f'{prefix}:{value}'.encode(), hashlib.sha256).hexdigest()[:10].upper()}"


def users_of(v, key=None):
    if isinstance(v, dict):
        return [u for k, x in v.items() for u in users_of(x, k)]
    if isinstance(v, list):
        return [u for x in v for u in users_of(x, key)]
    return [v] if isinstance(v, str) and key in J.USER_KEYS else []


def brute_masked(v, users, key=None):
    if isinstance(v, dict):
        return {k: brute_masked(x, users, k) for k, x in v.items()}
    if isinstance(v, list):
        return [brute_masked(x, users, key) for x in v]
    if not isinstance(v, str):
        return v
    for keys, prefix in ((J.USER_KEYS, "USER"), (J.IP_KEYS, "IP"), (J.PERSON_KEYS, "PERSON")):
        if key in keys:
            return token(prefix, v)
    v = re.sub(ids.IPV4_WORD, lambda m: token("IP", m.group()), v, flags=re.ASCII)
    v = re.sub(ids.PERSON_WORD, lambda m: token("PERSON", m.group()), v, flags=re.ASCII)
    for u in sorted({u for u in users if len(u) > 2 and u.upper() not in ("UNKNOWN", "NONE")}, key=lambda u: -len(u)):
        v = re.sub(rf"\b{re.escape(u)}\b", lambda m: token("USER", u), v, flags=re.ASCII)
    return v


def random_value(rnd, depth=0):
    kind = rnd.random()
    if depth < 5 and kind < .35:
        keys = ["a", "token", "owner", "user", "usernames", "source_ip", "person_id", "k}", "text", "é"]
        return {k: random_value(rnd, depth + 1) for k in rnd.sample(keys, rnd.randint(0, 5))}
    if depth < 5 and kind < .6:
        return [random_value(rnd, depth + 1) for _ in range(rnd.randint(0, 4))]
    return rnd.choice([1, -2.5e10, True, None, "", "token", "owner\":{", "annika", "unknown", "10.0.0.7", "P0012", "seen 10.0.0.7 by annika, P0012\n", "back\\slash }", "naïve, [x]", "it was bob\\E."])


def shaped(spark, texts, *columns):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    return sorted(rows.select("k", "t", *columns).collect(), key=lambda r: r.k)


def parsed(text):
    return None if text is None else json.loads(text)


def test_both_walks_against_parsed_values(spark):
    rnd = random.Random(2)
    values = [random_value(rnd) for _ in range(300)] + [{"users": 1, "user": ["annika", ["bob\\E", {"x": "annika"}], "al"], "note": "annika and bob\\E and al"}]
    spaces = [None, (", ", ": "), (" ,\n", "\t: ")]
    texts = [json.dumps(v, separators=rnd.choice(spaces), ensure_ascii=rnd.random() < .5) for v in values]
    found = shaped(spark, texts, J.drop_keys(F.col("t"), DENIED).alias("d"), J.mask_values(F.col("t"), KEY).alias("m"))
    for r, v in zip(found, values):
        assert r.d is not None and parsed(r.d) == brute_dropped(v), r.t
        assert parsed(r.m) == brute_masked(v, users_of(v)), r.t


def test_text_that_is_kept_stays_byte_for_byte(spark):
    deep = '{"a":' * 5000 + '{"token":[1,{"x":2}],"b":1}' + "}" * 5000
    odd = '{"a":"\\ud800","n":' + "1234567890" * 12 + ',"e":1e400,"a":0.10,"a" : [ 1 ,2 ] }'
    long = '{"keep":[' + ",".join(['{"token":1,"v":"' + "x" * 50 + '"}'] * 4000) + "]}"
    texts = [odd, odd.replace('"e":1e400,', '"token":{"a":[1]},'), deep, ESCAPED, long, '{"token":1}', '[{"owner":1},{"owner":2,"z":3}]']
    wanted = [odd, odd.replace('"e":1e400,', ""), deep.replace('"token":[1,{"x":2}],', ""), '{"a":2,"x\\"token":3,"c\\\\":4}', long.replace('"token":1,', ""), "{}", '[{},{"z":3}]']
    found = shaped(spark, texts, J.drop_keys(F.col("t"), DENIED).alias("d"), J.mask_values(F.col("t"), KEY).alias("m"))
    assert [r.d for r in found] == wanted
    assert [r.m for r in found[:3]] == texts[:3]
    limit = sys.getrecursionlimit()
    assert limit < 5000  # a recursive walk would have failed


def test_broken_text_gives_null(spark):
    texts = ['{"a":1', "}{", "{a:1}", '{"a":"x}', "", "[1,2", '"a" "b', None]
    found = shaped(spark, texts, J.drop_keys(F.col("t"), DENIED).alias("d"), J.mask_values(F.col("t"), KEY).alias("m"))
    assert [r.d for r in found] == [None] * 8 and [r.m for r in found] == [None] * 8


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([('{"token":1}',)], "t string").select(J.drop_keys(F.col("t"), DENIED), J.mask_values(F.col("t"), KEY))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_unmask(spark):
    texts = spark.createDataFrame([(1, f"{token('IP', '10.0.0.1')} met {token('USER', 'ann')}"), (2, "nothing"), (3, "IP-0123456789 is unknown"), (4, None)], "k int, t string")
    tokens = spark.createDataFrame([(token("IP", "10.0.0.1"), "10.0.0.1"), (token("USER", "ann"), "ann")], "token string, original string")
    found = {r.k: r.t for r in J.unmask(texts, "t", tokens, "k").collect()}
    assert found == {1: "10.0.0.1 met ann", 2: "nothing", 3: "IP-0123456789 is unknown", 4: None}
