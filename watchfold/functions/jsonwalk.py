"""Native walk over JSON text: keys dropped or values masked at any depth, everything else byte for byte as it was.

The text is cut into tokens by one regular expression, a fold over the tokens gives each a one-letter mark, and the marked tokens are joined again.
Nothing is parsed into values, so lone surrogates, deep nesting, long numbers, duplicate keys and spacing come through unchanged. The fold works in
slices of about the square root of the token count, so that marks are not copied once for every token of a long text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from watchfold.functions import ids
from watchfold.functions.jsontext import quoted

STRING = r'"(?:[^"\\]|\\.)*+"'
# Keys whose string values are identifiers.
USER_KEYS = ["usernames", "username", "user"]
IP_KEYS = ["source_ip", "ip", "ip_address"]
PERSON_KEYS = ["person_id", "nearest_employee_id", "recognized_person_id"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unescaped(literal: Column) -> Column:
    """Value of a JSON string literal; without escapes it is what stands between the quotes."""
    plain = F.substring(literal, 2, 2 ** 31 - 1)
    plain = F.left(plain, F.length(plain) - 1)
    return F.when(literal.contains("\\"), F.get_json_object(F.concat(F.lit('{"k":'), literal, F.lit("}")), "$.k")).otherwise(plain)


def scan(tokens: Column, kind: Callable[[Column], Column], start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """Struct of the last state and `marks`, one letter for each token. `kind` tells tokens apart by a letter of their own; `step` gives the
    next state and the mark from the state and that letter."""
    names = list(start)

    def one(state, letter):
        new = step(state, letter)
        return F.struct(*[new[n].alias(n) for n in names], state["before"].alias("before"), F.concat(state["marks"], new["mark"]).alias("marks"))

    def fold(letters):
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(letters))).cast("int"))

        def slice_of(state, at):
            opened = F.struct(*[state[n].alias(n) for n in names], F.concat(state["before"], state["marks"]).alias("before"), F.lit("").alias("marks"))
            return F.aggregate(F.slice(letters, at, size), opened, one)

        first = F.struct(*[c.alias(n) for n, c in start.items()], F.lit("").alias("before"), F.lit("").alias("marks"))
        starts = F.when(F.size(letters) > 0, F.sequence(F.lit(1), F.size(letters), size)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(starts, first, slice_of, lambda s: F.struct(*[s[n].alias(n) for n in names], F.concat(s["before"], s["marks"]).alias("marks")))

    return let(F.transform(tokens, kind), fold)


def _balanced(text: Column, tokens: Column, marked: Column) -> Column:
    """Whether the text can be JSON: the tokens cover it, brackets close, and a parser takes it unless it nests too deeply for one."""
    whole = (F.length(F.array_join(tokens, "")) == F.length(text)) & (marked["depth"] == 0) & ~marked["low"]
    deep = F.length(F.regexp_replace(text, r"[^\[{]", "")) > 900
    return whole & (deep | F.get_json_object(text, "$").isNotNull())


def drop_keys(text: Column, denied: list[str]) -> Column:
    """JSON text without the denied object keys and their values, at any depth. A key is compared by its value, so escapes
    do not hide it. Text that is not JSON gives null."""
    listed = "|".join(re.escape(k) for k in sorted(denied))
    # a key that may be denied takes its comma along; a key with an escape is looked at in the fold
    key = rf'\s*+,?\s*+"(?:(?:{listed})|[^"\\]*+\\.(?:[^"\\]|\\.)*+)"\s*+:'
    pattern = rf'(?s){key}|[{{}}\[\],]|(?:{STRING}|[^"{{}}\[\],])++'

    def kind(token):
        """o and c open and close, comma, denied key with (D) or without (d) the comma before it, kept key with that comma (e), blank, k anything else."""
        led = F.ltrim(token).startswith(",")
        gone = unescaped(F.regexp_extract(token, rf"(?s)({STRING})\s*+:$", 1)).isin(list(denied))
        key_kind = let(gone, lambda g: F.when(g & led, "D").when(g, "d").when(led, "e").otherwise("k"))
        return (F.when(token.isin("{", "["), "o").when(token.isin("}", "]"), "c").when(token == ",", ",").when(F.trim(token) == "", " ")
                .when(token.endswith(":") & token.rlike(f"(?s)^{key}$"), key_kind).otherwise("k"))

    def step(s, k):
        ends = (s["skip"] >= 0) & (s["depth"] == s["skip"]) & k.isin(",", "c", "D", "d", "e")
        kept, gone = (s["skip"] < 0) | ends, k.isin("D", "d")  # kept: this token is looked at as one of the kept text
        depth = F.when(k == "o", s["depth"] + 1).when(k == "c", s["depth"] - 1).otherwise(s["depth"])
        return {"depth": depth, "low": s["low"] | (depth < 0), "skip": F.when(kept & gone, s["depth"]).when(ends, -1).otherwise(s["skip"]),
                "fresh": F.when(~kept | k.isin("D", "d", ",", " "), s["fresh"]).otherwise(k == "o"),
                "mark": F.when(~kept | gone | ((k == ",") & s["fresh"]), "x").when((k == "e") & s["fresh"], "c").otherwise("k")}

    start = {"depth": F.lit(0), "low": F.lit(False), "skip": F.lit(-1), "fresh": F.lit(True)}

    def joined(value, tokens, marked):
        shown = lambda t, m: F.when(m == "x", "").when(m == "c", F.regexp_replace(t, r"^\s*+,", "")).otherwise(t)
        return F.when(_balanced(value, tokens, marked), F.array_join(F.zip_with(tokens, F.split(marked["marks"], ""), shown), ""))

    walked = lambda value: let(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), lambda tokens: let(scan(tokens, kind, start, step), lambda marked: joined(value, tokens, marked)))
    # most records hold nothing to drop: one search tells, and a parser vouches for the text unless it nests too deeply for one
    whole = lambda value: ~value.rlike(f"(?s){key}") & value.rlike(r"(?s)^\s*[\[{].*[\]}]\s*\z") & F.get_json_object(value, "$").isNotNull()
    return let(text, lambda value: F.when(whole(value), value).otherwise(walked(value)))


def mask_values(text: Column, key: bytes) -> Column:
    """JSON text with identifiers replaced by keyed pseudonyms at any depth.

    String values of identifier keys, also inside lists, become tokens of their kind. In every other string, addresses, person IDs and the
    record's own user names of three or more characters are replaced, as are its own addresses of four dotted numbers that are longer than an address's.
    Keys, numbers and literals stay. Text that is not JSON gives null."""
    pattern = rf'(?s){STRING}\s*+:|{STRING}|[{{}}\[\]]|[^"{{}}\[\]]++'

    def kind(token):
        """Kind of a key's values (U, I, P, - for other keys), s for a string, brackets as they are, k anything else."""
        name = let(unescaped(F.regexp_extract(token, f"(?s)^({STRING})", 1)), lambda n: F.when(n.isin(USER_KEYS), "U").when(n.isin(IP_KEYS), "I").when(n.isin(PERSON_KEYS), "P").otherwise("-"))
        return F.when(token.startswith('"'), F.when(token.endswith('"'), "s").otherwise(name)).when(token.isin("{", "[", "}", "]"), token).otherwise("k")

    def step(s, k):
        opens, closes = k.isin("{", "["), k.isin("}", "]")
        stack = (F.when(k == "[", F.concat(s["stack"], s["of"])).when(k == "{", F.concat(s["stack"], F.lit("o")))
                 .when(closes, F.left(s["stack"], F.length(s["stack"]) - 1)).otherwise(s["stack"]))
        depth = F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"])
        top = F.substring(s["stack"], -2, 1)  # where a closing bracket leads; a list's letter is the kind of its key, an object's is o
        of = F.when(k.isin("U", "I", "P", "-"), k).when(k == "{", "-").when(closes, F.when((s["depth"] > 1) & top.isin("U", "I", "P"), top).otherwise("-")).otherwise(s["of"])
        return {"stack": stack, "of": of, "depth": depth, "low": s["low"] | (depth < 0), "mark": F.when(k == "s", s["of"]).otherwise("k")}

    start = {"stack": F.lit(""), "of": F.lit("-"), "depth": F.lit(0), "low": F.lit(False)}

    def own(spots, mark):
        names = F.transform(F.filter(spots, lambda x: x["m"] == mark), lambda x: unescaped(x["t"]))
        known = F.filter(names, lambda n: (F.length(n) > 2) & ~F.upper(n).isin("UNKNOWN", "NONE"))
        return F.array_sort(F.array_distinct(known), lambda a, b: F.length(b) - F.length(a))  # a name inside a longer one comes after it

    def shown(spot, users, addresses):
        def free(content):
            whole = lambda n: F.concat(F.lit(r"\b\Q"), F.replace(n, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))
            replaced = lambda t, names, prefix: F.aggregate(names, t, lambda acc, n: F.when(acc.contains(n), F.regexp_replace(acc, whole(n), ids.pseudonym(key, prefix, n))).otherwise(acc))
            return replaced(replaced(ids.mask_text(key, content), addresses, "IP"), users, "USER")

        def replaced(content):
            token = lambda prefix: ids.pseudonym(key, prefix, content)
            new = F.when(spot["m"] == "U", token("USER")).when(spot["m"] == "I", token("IP")).when(spot["m"] == "P", token("PERSON")).otherwise(free(content))
            return let(new, lambda v: F.when(v.isNull() | (v == content), spot["t"]).otherwise(quoted(v)))

        return F.when(spot["m"] == "k", spot["t"]).otherwise(let(unescaped(spot["t"]), replaced))

    def joined(value, tokens, marked):
        spots = F.zip_with(tokens, F.split(marked["marks"], ""), lambda t, m: F.struct(t.alias("t"), m.alias("m")))
        text_of = lambda sp, users, addresses: F.array_join(F.transform(sp, lambda x: shown(x, users, addresses)), "")
        done = let(spots, lambda sp: let(own(sp, "U"), lambda users: let(F.filter(own(sp, "I"), lambda n: n.rlike(r"^\d+(\.\d+){3}\z")), lambda addresses: text_of(sp, users, addresses))))
        return F.when(_balanced(value, tokens, marked), done)

    return let(text, lambda value: let(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)),
                                       lambda tokens: let(scan(tokens, kind, start, step), lambda marked: joined(value, tokens, marked))))


def unmask(answers: DataFrame, answer: str, tokens: DataFrame, row: str) -> DataFrame:
    """(row, answer): free text with its tokens mapped back. tokens: (token, original), distinct; unknown tokens stay.

    Each distinct token of a text meets the mapping by an equi-join; no mapping is carried to all rows."""
    found = answers.select(row, F.explode(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\b(?:USER|IP|PERSON)-[0-9A-F]{10}\b"), F.lit(0)))).alias("token"))
    known = found.join(tokens.select("token", "original"), "token").groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("__known"))
    mapped = answers.join(known, row, "left")
    back = F.aggregate(F.map_entries("__known"), F.col(answer), lambda acc, e: F.replace(acc, e["key"], e["value"]))
    return mapped.select(row, F.when(F.col("__known").isNull(), F.col(answer)).otherwise(back).alias(answer))
