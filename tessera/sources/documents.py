"""Document sources: JSON and YAML texts with positions, globs, atomic sinks."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jsonpath import pointer_of

NODES = "source string, doc_index int, pointer string, kind string, value string, start_line int, start_char int, end_line int, end_char int"
PROBLEMS = "source string, doc_index int, code string, message string, start_line int, start_char int"


def read_texts(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(source, text): one row per file, read whole, in parallel."""
    reader = spark.read.option("wholetext", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(F.input_file_name().alias("source"), F.col("value").alias("text"))


def sniff(text: Column) -> Column:
    """json if the first character that is no blank opens an object or array, else yaml."""
    return F.when(F.ltrim(text).rlike(r"\A\s*[\[{]"), "json").otherwise("yaml")


def glob_pattern(glob: str) -> str:
    """An anchored regular expression: * within a segment, ** over segments, ?, {a,b}; without a slash the base name counts."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", c)
        i += 1
    return rf"\A{'' if '/' in glob else '(?:.*/)?'}{out}\z"


def glob_match(path: Column, glob: str) -> Column:
    return path.rlike(glob_pattern(glob))


@dataclass
class Node:
    path: tuple
    kind: str
    value: object
    start: int
    end: int


_SPACE = re.compile(r"[ \t\r\n]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_TEXT = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')


class JsonProblem(ValueError):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


def json_nodes(text: str) -> list[Node]:
    """Every value of a JSON text in document order with its place; comments and trailing commas are errors."""
    out: list[Node] = []

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def value(i: int, path: tuple, depth: int) -> tuple[int, object]:
        i = skip(i)
        if depth > 512:
            raise JsonProblem("nested too deeply", i)
        at = len(out)
        c = text[i : i + 1]
        out.append(Node(path, "", None, i, i))
        if c == "{":
            kind, v, j, seen = "object", {}, skip(i + 1), False
            while text[j : j + 1] != "}" or seen:
                m = _TEXT.match(text, j)
                if not m:
                    raise JsonProblem("expected a property name", j)
                key = json.loads(m[0])
                j = skip(m.end())
                if text[j : j + 1] != ":":
                    raise JsonProblem("expected a colon", j)
                j, v[key] = value(j + 1, (*path, key), depth + 1)
                j, seen = skip(j), False
                if text[j : j + 1] == ",":
                    j, seen = skip(j + 1), True
                elif text[j : j + 1] != "}":
                    raise JsonProblem("expected a comma or a closing brace", j)
            j += 1
        elif c == "[":
            kind, v, j, seen = "array", [], skip(i + 1), False
            while text[j : j + 1] != "]" or seen:
                j, x = value(j, (*path, len(v)), depth + 1)
                v.append(x)
                j, seen = skip(j), False
                if text[j : j + 1] == ",":
                    j, seen = skip(j + 1), True
                elif text[j : j + 1] != "]":
                    raise JsonProblem("expected a comma or a closing bracket", j)
            j += 1
        elif m := _TEXT.match(text, i):
            kind, v, j = "string", json.loads(m[0]), m.end()
        elif m := _NUMBER.match(text, i):
            kind, v, j = "number", json.loads(m[0]), m.end()
        else:
            for word, kind, v in (("true", "boolean", True), ("false", "boolean", False), ("null", "null", None)):
                if text.startswith(word, i):
                    j = i + len(word)
                    break
            else:
                raise JsonProblem("expected a value", i)
        out[at] = Node(path, kind, v, i, j)
        return j, v

    end, _ = value(0, (), 0)
    if skip(end) != len(text):
        raise JsonProblem("text follows the document", skip(end))
    return out


class Lines:
    """Offset to zero-based (line, character); lines end at LF, CRLF or CR."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer(r"\r\n|\n|\r", text))]

    def at(self, offset: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.starts, offset) - 1
        return line, offset - self.starts[line]


def yaml_nodes(text: str, repeated: list[tuple[int, str, int]] | None = None) -> list[list[Node]]:
    """For each document of a YAML stream its values in document order, with places.

    Of repeated keys of a mapping the last counts; document, message and offset of each are added to `repeated`. Values
    under a merge key have no place of their own, but count against the limit on what aliases may expand to.
    """
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml package") from e
    out = []
    most = max(100_000, min(20_000_000, 100 * len(text)))
    for root in yaml.compose_all(text, Loader=yaml.SafeLoader):
        nodes: list[Node] = []
        walked, seen = [0], set()

        def walk(n, path: tuple, active: tuple, nodes=nodes, walked=walked, seen=seen):
            if id(n) in active:
                raise JsonProblem("an alias leads back to itself", n.start_mark.index)
            walked[0] += 1
            if walked[0] > most:
                raise JsonProblem("aliases expand to too many nodes", n.start_mark.index)
            at = len(nodes)
            nodes.append(Node(path, "", None, n.start_mark.index, n.end_mark.index))
            if isinstance(n, yaml.MappingNode):
                v, merged, keys = {}, {}, set()
                for k, x in n.value:
                    key = str(scalar(k)) if isinstance(k, yaml.ScalarNode) else yaml.serialize(k).strip()
                    if key in keys and id(k) not in seen and repeated is not None:
                        repeated.append((len(out), f'Map key "{key}" is duplicated', k.start_mark.index))
                    seen.add(id(k))
                    keys.add(key)
                    if k.tag == "tag:yaml.org,2002:merge":
                        for y in x.value if isinstance(x, yaml.SequenceNode) else [x]:
                            hidden: list[Node] = []
                            got = walk(y, path, (*active, id(n)), hidden)
                            merged = {**got, **merged}
                        continue
                    v[key] = walk(x, (*path, key), (*active, id(n)), nodes)
                kind, v = "object", {**merged, **v}
            elif isinstance(n, yaml.SequenceNode):
                kind, v = "array", [walk(x, (*path, i), (*active, id(n)), nodes) for i, x in enumerate(n.value)]
            else:
                v = scalar(n)
                kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
            nodes[at] = Node(path, kind, v, n.start_mark.index, n.end_mark.index)
            return v

        if root is None:
            nodes.append(Node((), "null", None, 0, 0))
        else:
            walk(root, (), ())
        out.append(nodes)
    return out


def plain_scalar(text: str):
    """A plain scalar by the core schema of YAML 1.2."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE"):
        return True
    if text in ("false", "False", "FALSE"):
        return False
    if re.fullmatch(r"[-+]?[0-9]+", text):
        return int(text)
    if m := re.fullmatch(r"0o([0-7]+)|0x([0-9a-fA-F]+)", text):
        return int(m[1], 8) if m[1] else int(m[2], 16)
    if re.fullmatch(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?", text):
        return float(text)
    if re.fullmatch(r"[-+]?\.(?:inf|Inf|INF)", text):
        return float("-inf") if text[0] == "-" else float("inf")
    return float("nan") if text in (".nan", ".NaN", ".NAN") else text


def scalar(n):
    """The value of a scalar node: quoted and tagged ones are texts, plain ones follow the core schema."""
    short = n.tag.removeprefix("tag:yaml.org,2002:")
    if n.style in ("'", '"', "|", ">") and short == "str":
        return n.value
    if short == "str" and n.style is not None:
        return n.value
    if short in ("int", "float", "bool", "null", "str", "timestamp"):
        return plain_scalar(n.value)
    return n.value


def plain_scalar_kind(c: Column) -> Column:
    """The kind plain_scalar gives a text column, without Python."""
    return (
        F.when(c.isin("", "~", "null", "Null", "NULL"), "null")
        .when(c.isin("true", "True", "TRUE", "false", "False", "FALSE"), "boolean")
        .when(c.rlike(r"\A(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)\z"), "integer")
        .when(c.rlike(r"\A(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.nan|\.NaN|\.NAN)\z"), "number")
        .otherwise("string")
    )


def node_table(df: DataFrame, source: str = "source", text: str = "text", kind: str | None = None) -> DataFrame:
    """A row for every value of every document; texts that cannot be read have none (see problems)."""
    return _parsed(df, source, text, kind, True)


def problems(df: DataFrame, source: str = "source", text: str = "text", kind: str | None = None) -> DataFrame:
    """A row for every text that cannot be read, and one for each repeated key of a YAML mapping."""
    return _parsed(df, source, text, kind, False)


def _parsed(df: DataFrame, source: str, text: str, kind: str | None, want_nodes: bool) -> DataFrame:
    own = df.select(F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"), (F.lit(kind) if kind else sniff(F.col(text))).alias("kind"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for src, t, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t is None:
                    continue
                lines = Lines(t)
                try:
                    repeated: list = []
                    docs = [json_nodes(t)] if k == "json" else yaml_nodes(t, repeated)
                    if not want_nodes:
                        rows += [(src, d, "parser", message, *lines.at(at)) for d, message, at in repeated]
                    else:
                        for d, nodes in enumerate(docs):
                            for n in nodes:
                                value = None if n.kind in ("object", "array") else json.dumps(n.value, ensure_ascii=False)
                                rows.append((src, d, pointer_of(n.path), n.kind, value, *lines.at(n.start), *lines.at(n.end)))
                except JsonProblem as e:
                    if not want_nodes:
                        rows.append((src, 0, "parser", str(e), *lines.at(e.at)))
                except RuntimeError:
                    raise
                except Exception as e:
                    mark = getattr(e, "problem_mark", None)
                    if not want_nodes:
                        rows.append((src, 0, "parser", str(getattr(e, "problem", None) or e).splitlines()[0], mark.line if mark else 0, mark.column if mark else 0))
            schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32()}[k]) for n, k in (x.split() for x in (NODES if want_nodes else PROBLEMS).split(", "))])
            cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return own.mapInArrow(run, NODES if want_nodes else PROBLEMS)


def write_once(df: DataFrame, path: str) -> None:
    """Writes a new folder, whole or not at all; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)
