"""JSON documents: query by example, aggregation pipelines, JSON paths and SQL/JSON functions.

Documents are JSON text columns. Simple paths ($.a.b[0]) compile to native JSON functions; wildcards,
recursive descent, slices, filters and unions run in a vectorised function over Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- JSON paths -----------------------------------------------------------------------------------

_STEP = re.compile(r"\.\.|\.\*|\.([A-Za-z_][\w-]*)|\[\*\]|\[\?\((.+?)\)\]|\[(-?\d*):(-?\d*)(?::(-?\d+))?\]|\['([^']*)'\]|\[([^\]]+)\]|([A-Za-z_][\w-]*)")
_SIMPLE = re.compile(r"\$(\.[A-Za-z_]\w*|\[\d+\])*")


def parse_path(path: str) -> list[tuple]:
    """Steps of a path: child, index, wildcard, descend, slice, filter, union."""
    if not path.startswith(("$", "@")):
        raise ValueError(f"a path begins with $: {path}")
    steps, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad path at {at}: {path}")
        text, at = m[0], m.end()
        if text == "..":
            steps.append(("descend",))
        elif text in (".*", "[*]"):
            steps.append(("wildcard",))
        elif m[1] or m[8]:
            steps.append(("child", m[1] or m[8]))
        elif m[2]:
            steps.append(("filter", m[2]))
        elif m[6] is not None:
            steps.append(("child", m[6]))
        elif m[7] is not None:
            parts = [p.strip() for p in m[7].split(",")]
            keys = [int(p) if re.fullmatch(r"-?\d+", p) else p.strip("'\"") for p in parts]
            steps.append(("union", keys) if len(keys) > 1 else ("index", keys[0]) if isinstance(keys[0], int) else ("child", keys[0]))
        else:
            steps.append(("slice", *[int(x) if x else None for x in (m[3], m[4], m[5])]))
    return steps


def _condition(text: str) -> Callable[[object], bool]:
    """A filter expression: comparisons of @ paths with literals, =~, !, && and ||."""
    for op, join in (("||", any), ("&&", all)):
        parts = [p.strip() for p in text.split(op)]
        if len(parts) > 1:
            tests = [_condition(p) for p in parts]
            return lambda v: join(t(v) for t in tests)
    text = text.strip()
    if text.startswith("!"):
        inner = _condition(text[1:].strip().strip("()"))
        return lambda v: not inner(v)
    m = re.fullmatch(r"(@[^=!<>~]*?)\s*(==|!=|<=|>=|<|>|=~)\s*(.+)", text)
    if not m:
        steps = parse_path(text)
        return lambda v: any(x not in (None, False) for x in walk(v, steps))
    steps, op, raw = parse_path(m[1].strip()), m[2], m[3].strip()
    if op == "=~":
        pattern = re.compile(raw.strip("/'\""))
        return lambda v: any(isinstance(x, str) and pattern.search(x) for x in walk(v, steps))
    want = raw[1:-1] if raw[0] in "'\"" else json.loads(raw)

    def holds(x) -> bool:
        if op in ("==", "!="):
            return (x == want) == (op == "==")
        number = lambda y: isinstance(y, (int, float)) and not isinstance(y, bool)
        if not (number(x) and number(want) or isinstance(x, str) and isinstance(want, str)):
            return False
        return {"<": x < want, "<=": x <= want, ">": x > want, ">=": x >= want}[op]

    return lambda v: any(holds(x) for x in walk(v, steps))


def walk(value, steps: Sequence[tuple]) -> list:
    """Everything that the steps reach from a value, in document order."""
    found = [value]
    for n, step in enumerate(steps):
        kind, out = step[0], []
        if kind == "descend":
            for v in found:
                stack = [v]
                while stack:
                    x = stack.pop()
                    out += walk(x, steps[n + 1 :])
                    stack += reversed(list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else [])
            return out
        for v in found:
            if kind == "child" and isinstance(v, dict) and step[1] in v:
                out.append(v[step[1]])
            elif kind == "wildcard" and isinstance(v, (dict, list)):
                out += list(v.values()) if isinstance(v, dict) else v
            elif kind == "index" and isinstance(v, list) and -len(v) <= step[1] < len(v):
                out.append(v[step[1]])
            elif kind == "slice" and isinstance(v, list):
                out += v[slice(*step[1:])]
            elif kind == "union":
                for k in step[1]:
                    if isinstance(v, dict) and k in v or isinstance(v, list) and isinstance(k, int) and -len(v) <= k < len(v):
                        out.append(v[k])
            elif kind == "filter" and isinstance(v, (dict, list)):
                test = _condition(step[1])
                out += [x for x in (v.values() if isinstance(v, dict) else v) if test(x)]
        found = out
    return found


def _loads(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


_dumps = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def _udf(f: Callable, kind: str = "string"):
    """A function of one text as a vectorised function; equal texts of a batch are looked at once."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        known = {x: f(x) for x in s.dropna().unique()}
        return pd.Series([known.get(x) if isinstance(x, str) else None for x in s], dtype=object)

    return run


def json_path(doc: Column, path: str) -> Column:
    """JSON array of all matches; null for null or malformed documents."""
    steps = parse_path(path)
    return _udf(lambda t: None if (x := _loads(t)) is None else _dumps(walk(x, steps)))(doc)


def json_value(doc: Column, path: str, kind: str = "string") -> Column:
    """The scalar at a path, cast; null if there is none or it doesn't cast."""
    if _SIMPLE.fullmatch(path):
        return F.try_variant_get(F.try_parse_json(doc), path, kind)
    steps = parse_path(path)

    def one(t: str):
        found = walk(_loads(t), steps)
        return str(found[0]) if len(found) == 1 and not isinstance(found[0], (dict, list)) else None

    return _udf(one)(doc).try_cast(kind)


def json_query(doc: Column, path: str, wrapper: str = "none") -> Column:
    """The JSON at a path. wrapper: none (several matches become an array), with (always an array), without (several matches are null)."""
    steps = parse_path(path)

    def run(t: str):
        found = walk(_loads(t), steps)
        if not found:
            return None
        if wrapper == "with" or wrapper == "none" and len(found) > 1:
            return _dumps(found)
        return _dumps(found[0]) if len(found) == 1 else None

    return _udf(run)(doc)


def json_exists(doc: Column, path: str) -> Column:
    if _SIMPLE.fullmatch(path):
        return F.get_json_object(doc, path).isNotNull()
    steps = parse_path(path)
    return F.coalesce(_udf(lambda t: bool(walk(_loads(t), steps)), "boolean")(doc), F.lit(False))


def is_json(doc: Column, kind: str = "any") -> Column:
    v = F.try_parse_json(doc)
    name = F.schema_of_variant(v)
    test = {"any": F.lit(True), "object": name.startswith("OBJECT"), "array": name.startswith("ARRAY"), "scalar": ~(name.startswith("OBJECT") | name.startswith("ARRAY"))}[kind]
    return F.coalesce(v.isNotNull() & test, F.lit(False))


def json_table(df: DataFrame, doc: str, row_path: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each match of row_path; columns: name -> (path, type), the first match or null."""
    rows = df.withColumn("_r", F.explode(F.from_json(json_path(F.col(doc), row_path), "array<string>")))
    return rows.select(*df.columns, *[json_value(F.col("_r"), p, t).alias(n) for n, (p, t) in columns.items()])


def merge_patch(target, patch):
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def json_mergepatch(doc: Column, patch: str) -> Column:
    p = json.loads(patch)
    return _udf(lambda t: _dumps(merge_patch(_loads(t), p)))(doc)


def transformed(value, operations: Sequence[tuple]):
    """JSON_TRANSFORM: (op, path of keys, value): set, insert, replace, remove, rename, append."""
    value = json.loads(json.dumps(value))
    for op, keys, *arg in operations:
        at = value
        for k in keys[:-1]:
            if isinstance(at, dict) and k not in at and op in ("set", "insert"):
                at[k] = {}
            at = at.get(k) if isinstance(at, dict) else at[k] if isinstance(at, list) and isinstance(k, int) and k < len(at) else None
            if at is None:
                break
        k = keys[-1]
        if not isinstance(at, (dict, list)):
            continue
        there = k in at if isinstance(at, dict) else isinstance(k, int) and k < len(at)
        if op == "set" or op == "insert" and not there or op == "replace" and there:
            at[k] = arg[0]
        elif op == "remove" and there:
            del at[k]
        elif op == "rename" and there:
            at[arg[0]] = at.pop(k)
        elif op == "append" and there and isinstance(at[k], list):
            at[k].append(arg[0])
    return value


def json_transform(doc: Column, *operations: tuple) -> Column:
    return _udf(lambda t: _dumps(transformed(_loads(t), operations)))(doc)


def json_set(doc: Column, keys: Sequence, value) -> Column:
    return json_transform(doc, ("set", list(keys), value))


def json_delete(doc: Column, keys: Sequence) -> Column:
    return json_transform(doc, ("remove", list(keys)))


def contains_value(value, search) -> bool:
    """Whether search is part of value: its keys and values of objects, its members of arrays."""
    if isinstance(value, dict) and isinstance(search, dict):
        return all(k in value and contains_value(value[k], v) for k, v in search.items())
    if isinstance(value, list):
        return all(any(contains_value(x, s) for x in value) for s in (search if isinstance(search, list) else [search]))
    return value == search


def json_contains(doc: Column, search: str) -> Column:
    s = json.loads(search)
    return F.coalesce(_udf(lambda t: contains_value(_loads(t), s), "boolean")(doc), F.lit(False))


def json_diff(a: Column, b: Column) -> Column:
    """JSON array of {op, path, value} that turn the first document into the second."""

    def diff(x, y, path: str) -> list:
        if isinstance(x, dict) and isinstance(y, dict):
            out = []
            for k in sorted(x.keys() | y.keys()):
                p = f"{path}/{k}"
                out += [{"op": "remove", "path": p}] if k not in y else [{"op": "add", "path": p, "value": y[k]}] if k not in x else diff(x[k], y[k], p)
            return out
        return [] if x == y else [{"op": "replace", "path": path, "value": y}]

    @F.pandas_udf("string")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([_dumps(diff(_loads(x), _loads(y), "")) for x, y in zip(s, t)])

    return run(a, b)


# --- query by example -----------------------------------------------------------------------------


def _typed(v: Column, path: str, like) -> Column:
    kind = "boolean" if isinstance(like, bool) else "double" if isinstance(like, (int, float)) else "string"
    value = F.try_variant_get(v, path, kind)
    name = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    same = {"boolean": name == "BOOLEAN", "double": name.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "string": name == "STRING"}[kind]
    return F.when(same, value)


def matches(doc: Column, example: dict) -> Column:
    """A query-by-example as a condition. Comparisons want the same type; $ne and $nin match missing fields; null counts as missing."""
    return _all(F.try_parse_json(doc), doc, example)


def _all(v: Column, doc: Column, example: dict) -> Column:
    out = F.lit(True)
    for key, want in example.items():
        if key in ("$and", "$or", "$nor"):
            parts = [_all(v, doc, e) for e in want]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if key == "$and" else joined | p
            out = out & (~joined if key == "$nor" else joined)
        elif key == "$not":
            out = out & ~_all(v, doc, want)
        elif isinstance(want, dict) and any(k.startswith("$") for k in want):
            for op, arg in want.items():
                out = out & _operator(v, doc, "$." + key, op, arg)
        else:
            out = out & _operator(v, doc, "$." + key, "$eq", want)
    return out


def _operator(v: Column, doc: Column, path: str, op: str, arg) -> Column:
    no = F.lit(False)
    raw = F.get_json_object(doc, path)
    if op in ("$eq", "$ne"):
        if arg is None:
            same = raw.isNull()
        elif isinstance(arg, (dict, list)):
            same = F.coalesce(raw == _dumps(arg), no)
        else:
            same = F.coalesce(_typed(v, path, arg) == F.lit(float(arg) if isinstance(arg, (int, float)) and not isinstance(arg, bool) else arg), no)
        return same if op == "$eq" else ~same
    if op in ("$gt", "$gte", "$lt", "$lte"):
        x, y = _typed(v, path, arg), F.lit(float(arg) if isinstance(arg, (int, float)) else arg)
        return F.coalesce({"$gt": x > y, "$gte": x >= y, "$lt": x < y, "$lte": x <= y}[op], no)
    if op in ("$in", "$nin"):
        found = no
        for a in arg:
            found = found | _operator(v, doc, path, "$eq", a)
        return found if op == "$in" else ~found
    if op == "$exists":
        return raw.isNotNull() if arg else raw.isNull()
    if op == "$regex":
        return F.coalesce(_typed(v, path, "").rlike(arg), no)
    if op == "$mod":
        return F.coalesce(F.pmod(_typed(v, path, 0).cast("long"), F.lit(arg[0])) == arg[1], no)
    if op == "$size":
        return F.coalesce(F.json_array_length(raw) == arg, no)
    if op == "$type":
        name = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        return F.coalesce({"string": name == "STRING", "number": name.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), "bool": name == "BOOLEAN", "boolean": name == "BOOLEAN", "array": name.startswith("ARRAY"), "object": name.startswith("OBJECT"), "null": name == "VOID"}[arg], no)
    if op == "$all":
        items = F.from_json(raw, "array<string>")
        return F.coalesce(F.size(F.array_except(F.array(*[F.lit(a if isinstance(a, str) else _dumps(a)) for a in arg]), items)) == 0, no)
    if op == "$elemMatch":
        rows = F.from_json(raw, "array<string>")
        return F.coalesce(F.exists(rows, lambda x: _all(F.try_parse_json(x), x, arg)), no)
    if op == "$not":
        inner = F.lit(True)
        for o, a in arg.items():
            inner = inner & _operator(v, doc, path, o, a)
        return ~inner
    raise ValueError(f"no operator {op}")


# --- aggregation pipelines ------------------------------------------------------------------------


def expression(e) -> Column:
    """A pipeline expression: '$field', a literal, or an operator with arguments."""
    if isinstance(e, str) and e.startswith("$"):
        return F.col(e[1:])
    if not isinstance(e, dict):
        return F.lit(e)
    ((op, args),) = e.items()
    if op == "$cond":
        test, yes, no = (args["if"], args["then"], args["else"]) if isinstance(args, dict) else args
        return F.when(expression(test), expression(yes)).otherwise(expression(no))
    xs = [expression(a) for a in (args if isinstance(args, list) else [args])]
    fold = {"$add": lambda a, b: a + b, "$subtract": lambda a, b: a - b, "$multiply": lambda a, b: a * b, "$divide": lambda a, b: a / b, "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b, "$eq": lambda a, b: a == b, "$ne": lambda a, b: a != b}
    if op == "$concat":
        return F.concat(*[x.cast("string") for x in xs])
    if op not in fold:
        raise ValueError(f"no expression {op}")
    out = xs[0]
    for x in xs[1:]:
        out = fold[op](out, x)
    return out


def _accumulator(spec: dict) -> Column:
    ((op, arg),) = spec.items()
    x = expression(arg) if op != "$count" else F.lit(1)
    return {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max, "$count": F.count, "$first": F.first, "$last": F.last, "$push": F.collect_list, "$addToSet": F.collect_set}[op](x)


def aggregate(df: DataFrame, pipeline: Sequence[dict], others: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run pipeline stages over a table of typed columns. $facet gives one row with an array for each facet."""
    from skeinql.operators.joins import lookup

    for stage in pipeline:
        ((op, arg),) = stage.items()
        if op == "$match":
            df = df.where(_match(arg))
        elif op == "$project":
            df = df.select(*[F.col(k) if v in (1, True) else expression(v).alias(k) for k, v in arg.items() if v not in (0, False)]) if any(v not in (0, False) for v in arg.values()) else df.drop(*arg)
        elif op == "$group":
            key = arg["_id"]
            aggs = [_accumulator(v).alias(k) for k, v in arg.items() if k != "_id"]
            df = df.agg(*aggs).withColumn("_id", F.lit(None)) if key is None else df.groupBy(*[expression(v).alias(k) for k, v in key.items()] if isinstance(key, dict) else [expression(key).alias("_id")]).agg(*aggs)
        elif op == "$sort":
            df = df.orderBy(*[F.col(k).asc_nulls_first() if d > 0 else F.col(k).desc_nulls_last() for k, d in arg.items()])
        elif op == "$limit":
            df = df.limit(arg)
        elif op == "$skip":
            df = df.offset(arg)
        elif op == "$unwind":
            path, keep = (arg, False) if isinstance(arg, str) else (arg["path"], arg.get("preserveNullAndEmptyArrays", False))
            df = df.withColumn(path[1:], (F.explode_outer if keep else F.explode)(path[1:]))
        elif op in ("$addFields", "$set"):
            df = df.withColumns({k: expression(v) for k, v in arg.items()})
        elif op == "$count":
            df = df.agg(F.count("*").alias(arg))
        elif op == "$replaceRoot":
            df = df.select(f"{arg['newRoot'][1:]}.*")
        elif op == "$lookup":
            df = lookup(df, others[arg["from"]], arg["localField"], arg["foreignField"], arg["as"])
        elif op == "$facet":
            parts = [aggregate(df, p, others) for p in arg.values()]
            rows = [p.agg(F.collect_list(F.struct(*p.columns)).alias(n)) for n, p in zip(arg, parts)]
            df = rows[0]
            for r in rows[1:]:
                df = df.crossJoin(r)
        else:
            raise ValueError(f"no stage {op}")
    return df


def _match(query: dict) -> Column:
    out = F.lit(True)
    for key, want in query.items():
        if key in ("$and", "$or"):
            parts = [_match(q) for q in want]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if key == "$and" else joined | p
            out = out & joined
        else:
            c = F.col(key)
            for op, a in (want if isinstance(want, dict) else {"$eq": want}).items():
                out = out & {"$eq": lambda: c == a, "$ne": lambda: c != a, "$gt": lambda: c > a, "$gte": lambda: c >= a, "$lt": lambda: c < a, "$lte": lambda: c <= a, "$in": lambda: c.isin(a), "$nin": lambda: ~c.isin(a), "$exists": lambda: c.isNotNull() if a else c.isNull(), "$regex": lambda: c.rlike(a)}[op]()
    return out


# --- collections ----------------------------------------------------------------------------------


def upsert(base: DataFrame, news: DataFrame, key: Sequence[str]) -> DataFrame:
    return base.join(news.select(*key), list(key), "left_anti").unionByName(news.select(*base.columns))


def expired(df: DataFrame, ts: str, seconds: int, now: Column) -> DataFrame:
    """Rows past their time to live."""
    return df.where(F.col(ts) + F.make_interval(secs=F.lit(seconds)) <= now)


def schema_errors(doc: Column, required: Sequence[str], types: dict[str, str]) -> Column:
    """Names of required fields that are missing and of fields of a wrong type."""
    v = F.try_parse_json(doc)
    missing = [F.when(F.get_json_object(doc, f"$.{f}").isNull(), F.lit(f"missing {f}")) for f in required]
    wrong = [F.when(F.get_json_object(doc, f"$.{f}").isNotNull() & ~_operator(v, doc, f"$.{f}", "$type", t), F.lit(f"type of {f}")) for f, t in types.items()]
    return F.filter(F.array(*missing, *wrong), lambda x: x.isNotNull())


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is_kind(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, _KINDS[kind]) and not (kind != "boolean" and isinstance(value, bool))


def check_schema(value, schema: dict | bool, at: str = "$") -> list[str]:
    """What of a JSON schema a value does not meet, as 'path: rule', in the order of the schema's rules."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: nothing is allowed"]
    out: list[str] = []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    for rule, want in schema.items():
        bad = False
        if rule == "type":
            bad = not any(_is_kind(value, k) for k in ([want] if isinstance(want, str) else want))
        elif rule in ("enum", "const"):
            bad = not any(x == value and type(x) is type(value) or number and x == value and not isinstance(x, bool) for x in (want if rule == "enum" else [want]))
        elif number and rule in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
            bad = {"minimum": lambda: value < want, "maximum": lambda: value > want, "exclusiveMinimum": lambda: value <= want, "exclusiveMaximum": lambda: value >= want, "multipleOf": lambda: abs(value / want - round(value / want)) > 1e-9}[rule]()
        elif isinstance(value, str) and rule in ("minLength", "maxLength", "pattern"):
            bad = {"minLength": lambda: len(value) < want, "maxLength": lambda: len(value) > want, "pattern": lambda: not re.search(want, value)}[rule]()
        elif isinstance(value, list) and rule in ("minItems", "maxItems", "uniqueItems", "items", "contains"):
            if rule == "items":
                out += [e for i, x in enumerate(value) for e in check_schema(x, want, f"{at}[{i}]")]
            bad = {"minItems": lambda: len(value) < want, "maxItems": lambda: len(value) > want, "uniqueItems": lambda: want and len({_dumps(x) for x in value}) < len(value), "items": lambda: False, "contains": lambda: all(check_schema(x, want) for x in value)}[rule]()
        elif isinstance(value, dict) and rule in ("required", "properties", "patternProperties", "additionalProperties", "minProperties", "maxProperties", "dependentRequired"):
            if rule == "required":
                out += [f"{at}.{k}: required" for k in want if k not in value]
            elif rule == "properties":
                out += [e for k, sub in want.items() if k in value for e in check_schema(value[k], sub, f"{at}.{k}")]
            elif rule == "patternProperties":
                out += [e for p, sub in want.items() for k, x in value.items() if re.search(p, k) for e in check_schema(x, sub, f"{at}.{k}")]
            elif rule == "additionalProperties":
                known = lambda k: k in schema.get("properties", {}) or any(re.search(p, k) for p in schema.get("patternProperties", {}))
                out += [e if isinstance(want, dict) else f"{at}.{k}: not allowed" for k, x in value.items() if not known(k) for e in check_schema(x, want, f"{at}.{k}")]
            elif rule == "dependentRequired":
                out += [f"{at}.{n}: required with {k}" for k, need in want.items() if k in value for n in need if n not in value]
            else:
                bad = len(value) < want if rule == "minProperties" else len(value) > want
        elif rule == "allOf":
            out += [e for sub in want for e in check_schema(value, sub, at)]
        elif rule in ("anyOf", "oneOf"):
            good = sum(not check_schema(value, sub, at) for sub in want)
            bad = good == 0 if rule == "anyOf" else good != 1
        elif rule == "not":
            bad = not check_schema(value, want, at)
        elif rule == "if":
            branch = schema.get("then", True) if not check_schema(value, want, at) else schema.get("else", True)
            out += check_schema(value, branch, at)
        if bad:
            out.append(f"{at}: {rule}")
    return out


def json_schema_errors(doc: Column, schema: dict) -> Column:
    """What of a JSON schema documents don't meet (empty for valid ones); a malformed document has '$: malformed', null stays null."""

    def one(text: str) -> list[str]:
        try:
            return check_schema(json.loads(text), schema)
        except ValueError:
            return ["$: malformed"]

    return _udf(one, "array<string>")(doc)


def geo_near(doc: Column, path: str, lon: float, lat: float, most: float | None = None, least: float = 0.0) -> Column:
    """$near: whether a GeoJSON point at a path is between two distances in metres from a place."""
    from skeinql.operators.spatial import haversine

    x, y = (F.get_json_object(doc, f"{path}.coordinates[{k}]").cast("double") for k in (0, 1))
    d = haversine(y, x, F.lit(lat), F.lit(lon))
    return F.coalesce((d >= least) & (d <= most if most is not None else F.lit(True)), F.lit(False))


def geo_within_box(doc: Column, path: str, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """$geoWithin with $box: longitudes and latitudes between two corners."""
    x, y = (F.get_json_object(doc, f"{path}.coordinates[{k}]").cast("double") for k in (0, 1))
    return F.coalesce(x.between(low[0], high[0]) & y.between(low[1], high[1]), F.lit(False))


def geo_relates(doc: Column, path: str, geometry: dict, how: str = "intersects") -> Column:
    """$geoIntersects and $geoWithin (how: within) with a GeoJSON geometry, in the plane."""
    from skeinql.operators import planar

    shape = (geometry["type"].upper(), geometry["coordinates"])

    def one(text: str) -> bool:
        found = _loads(text)
        if not isinstance(found, dict) or "coordinates" not in found:
            return False
        own = (str(found["type"]).upper(), found["coordinates"])
        return planar.covers(shape, own) if how == "within" else planar.intersects(own, shape)

    return F.coalesce(_udf(one, "boolean")(F.get_json_object(doc, path)), F.lit(False))
