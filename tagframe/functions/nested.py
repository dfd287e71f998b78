"""Lists, dicts and grids inside cells: one canonical JSON text for all formats, rewritten token by token.

Canonical text is the ``_kind`` form of JSON with sorted names, no blanks and plain numbers, so that values are deeply equal
when their texts are, but for the display names of references (``comparable``). Nesting of any depth needs no recursion:
a token's text depends on the token before it alone.

Defined cases: text whose names repeat inside one dict stays in its order; a dict's entry without value is a marker, one with
``N`` is null; a grid inside another value of the prefix form stays a dict of its parts, and there is no Zinc text for grids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Scalar = Callable[[Column], Column]

_STRING = r'"(?:[^"\\]|\\.)*+"'
_MARKER = '{"_kind":"marker"}'
_ZINC_TOKEN = "|".join(
    [
        _STRING, r"`(?:[^`\\]|\\.)*+`", rf"@[A-Za-z0-9_:.~-]+(?:\s+{_STRING})?", r"\d{4}-\d\d-\d\dT[^\s,\[\]{}]+(?:\s+[A-Z][\w+/-]*)?",
        r"\^[\w:.~-]+", rf"[A-Z]\w*\((?:[^)\"]|{_STRING})*+\)", r"[a-z]\w*\s*:", r"[a-z]\w*", r"[\[\]{}]", r"[^\s,\[\]{}]+",
    ]
)
#: An object of one scalar: its names are sorted, so its kind stands first.
_OBJECT = rf'\{{"_kind":"(?!dict"|grid")\w+"(?:[^{{}}"]|{_STRING})*+\}}'
_JSON_TOKEN = "|".join([_OBJECT, rf"{_STRING}\s*:", _STRING, r"[\[\]{},]", r'[^\s,\[\]{}:"]+'])
#: A string without escapes and control characters: its text is its content between two quotes, in every format.
BARE = r'[^"\\\x00-\x1f]'
PLAIN = rf'\A"{BARE}*+"\z'
_UNPREFIXED = rf'"(?!.:){BARE}*+"'
# Texts of brackets, names and such strings alone are rewritten as a whole, without looking at tokens. In Zinc a string then has no
# bracket, comma or colon and isn't empty, so that these signs and two quotes side by side are always outside.
_PLAIN_ZINC = r'\A(?:[\[\]{},\s]|[a-z]\w*+\s*+:|"[^"\\\[\]{},:\x00-\x1f]++")*+\z'
_PLAIN_TO_ZINC = r'\A(?:[\[\]{},]|"[a-z]\w*+":|"[^"\\$\x00-\x1f]*+")*+\z'
_PLAIN_JSON = rf'\A(?:[\[\]{{}},:]|"(?!_kind"){_UNPREFIXED[1:]}|true|false|null)*+\z'


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed, and planned, once however often ``f`` looks at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _rewritten(text: Column, pattern: str, f: Callable[[Column, Column], Column]) -> Column:
    """The texts that ``f`` makes of each token and the one before it, joined."""
    each = lambda t, b: F.when(t.isNotNull(), f(t, b))
    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda ts: F.array_join(F.zip_with(ts, F.array_prepend(ts, F.lit("")), each), ""))


def _is_mark(token: Column) -> Column:
    return token.isin("[", "]", "{", "}", ",")


def _is_name(token: Column) -> Column:
    """A token of JSON is a name of a dict; strings end with their quote."""
    return token.endswith('":')


def canonical(text: Column) -> Column:
    """JSON with sorted names and no blanks."""
    return _bound(text, lambda t: F.coalesce(F.to_json(F.try_parse_json(t)), t))


def from_zinc(text: Column, scalar: Scalar) -> Column:
    """Canonical text of a Zinc list or dict; ``scalar`` turns a Zinc scalar into JSON."""

    def token(t: Column, b: Column) -> Column:
        name = F.regexp_extract(t, r"^([a-z]\w*)\s*:?$", 1)
        joint = F.when(b.isin("", "[", "{") | b.rlike(r"^[a-z]\w*\s*:$") | t.isin("]", "}"), "").otherwise(",")
        return F.concat(joint, F.when(t.isin("[", "]", "{", "}") | t.rlike(PLAIN), t).when(name == "", F.coalesce(scalar(t), F.lit("null"))).when(t.endswith(":"), F.concat(F.lit('"'), name, F.lit('":'))).otherwise(F.concat(F.lit('"'), name, F.lit('":' + _MARKER))))

    def whole(t: Column) -> Column:
        named = F.regexp_replace(t, r"([a-z]\w*+)\s*+:", '"$1":')
        tight = F.regexp_replace(named, r'("[^"]*+")|[\s,]++', "$1")
        return F.regexp_replace(tight, r'(?<=["\]}])(?=["\[{])', ",")

    return canonical(_bound(text, lambda t: F.when(t.rlike(_PLAIN_ZINC), whole(t)).otherwise(_rewritten(t, _ZINC_TOKEN, token))))


def _same_text(token: Column) -> Column:
    """A string that all forms of JSON write alike: it has no prefix and nothing to escape."""
    return token.rlike(rf"\A{_UNPREFIXED}\z")


def from_json(text: Column, scalar: Scalar) -> Column:
    """Canonical text of a JSON list, dict or grid; ``scalar`` turns a scalar of its form into the ``_kind`` form."""
    token = lambda t, b: F.when(_is_mark(t) | _is_name(t) | _same_text(t), t).otherwise(F.coalesce(scalar(t), F.lit("null")))
    tokens = lambda t: canonical(_rewritten(F.regexp_replace(t, r'\{"_kind":"dict",?', "{"), _JSON_TOKEN, token))
    return _bound(canonical(text), lambda t: F.when(t.rlike(_PLAIN_JSON), t).otherwise(tokens(t)))


def to_zinc(text: Column, scalar: Scalar) -> Column:
    """Zinc text of a canonical list or dict; ``scalar`` turns JSON into a Zinc scalar. A grid is an error."""

    def token(t: Column, b: Column) -> Column:
        named = _is_name(b)
        body = F.when(_is_mark(t) | (t.rlike(PLAIN) & ~t.contains("$")), t).otherwise(F.coalesce(F.nullif(scalar(t), F.lit("")), F.lit("N")))
        return F.when(_is_name(t), F.substr(t, F.lit(2), F.length(t) - 3)).when(named & (t == _MARKER), "").when(named, F.concat(F.lit(":"), body)).otherwise(body)

    whole = lambda t: F.regexp_replace(t, r'"([a-z]\w*+)":', "$1:")
    grid = F.raise_error(F.lit("no Zinc scalar for grid")).cast("string")
    return _bound(text, lambda t: F.when(t.rlike(_PLAIN_TO_ZINC), whole(t)).when(t.contains('{"_kind":"grid"'), grid).otherwise(_rewritten(t, _JSON_TOKEN, token)))


def to_json3(text: Column, scalar: Scalar) -> Column:
    """Prefix-form text of a canonical value; ``scalar`` turns the ``_kind`` form into it."""
    token = lambda t, b: F.when(_is_mark(t) | _is_name(t) | _same_text(t), t).otherwise(scalar(t))
    tokens = lambda t: canonical(_rewritten(F.regexp_replace(t, r'\{"_kind":"grid",?', "{"), _JSON_TOKEN, token))
    return _bound(text, lambda t: F.when(t.rlike(_PLAIN_JSON), t).otherwise(tokens(t)))


def comparable(text: Column) -> Column:
    """Canonical text without the display names of references: two values are deeply equal when these are."""
    return F.regexp_replace(text, rf'(\{{"_kind":"ref"),"dis":{_STRING}', "$1")


def items(text: Column) -> Column:
    """The elements of a canonical list, each as its own text."""
    return F.transform(F.from_json(text, "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))


def entries(text: Column) -> Column:
    """The entries of a canonical dict, each value as its own text."""
    return F.transform_values(F.from_json(text, "map<string,variant>"), lambda _, x: F.coalesce(F.to_json(x), F.lit("null")))
