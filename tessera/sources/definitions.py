"""Readers and writers of gadget definitions, automata, puzzles and names."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFINITION = "name string, uedges array<array<int>>, dedges array<array<int>>, pragma array<string>, alias_of string, state_names map<int,string>, all_states boolean"


def _rows(text: str, kind: str):
    """Definitions and aliases of one document, as rows of DEFINITION."""
    if kind == "json":
        import json

        doc = json.loads(text)
    else:
        import yaml

        doc = yaml.safe_load(text)
    doc = doc or {}
    tunnels = doc if "gadgets" not in doc and "aliases" not in doc else doc.get("gadgets") or {}
    for name, g in tunnels.items():
        pragma = g.get("pragma") or []
        called = g.get("state-names")
        if called is not None and called != "all" and not isinstance(called, dict):
            raise ValueError(f"{name}: state-names {called!r}")
        named = {int(k): v if v is None else str(v) for k, v in called.items()} if isinstance(called, dict) else None
        yield name, [list(e) for e in g.get("uedges") or []], [list(e) for e in g.get("dedges") or []], [pragma] if isinstance(pragma, str) else list(pragma), None, named, called == "all"
    for name, of in (doc.get("aliases") or {}).items() if "gadgets" in doc or "aliases" in doc else ():
        yield name, None, None, None, of, None, False


def read_gadgets(spark: SparkSession, path: str) -> DataFrame:
    """Definitions of .yaml, .yml or .json documents, one row each; documents are parsed on the executors."""
    kind = os.path.splitext(path)[1].lstrip(".").lower()
    if kind not in ("yaml", "yml", "json"):
        raise ValueError(f"no reader for {path!r}")

    def parse(frames):
        import pandas as pd

        for frame in frames:
            rows = [r for text in frame["value"] for r in _rows(text, kind)]
            yield pd.DataFrame(rows, columns=["name", "uedges", "dedges", "pragma", "alias_of", "state_names", "all_states"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, DEFINITION)


def edges_of(definitions: DataFrame) -> DataFrame:
    """(name, s, a, b, t, directed) of definitions."""
    listed = definitions.select("name", F.explode(F.concat(*(F.transform(F.coalesce(c, F.array().cast("array<array<int>>")), lambda e, d=d: F.struct(e.alias("e"), F.lit(d).alias("directed"))) for c, d in (("uedges", False), ("dedges", True))))).alias("x"))
    return listed.select("name", *[F.col("x.e")[k].alias(n) for k, n in enumerate("sabt")], "x.directed")


def read_drawio(spark: SparkSession, path: str) -> DataFrame:
    """(group, source, target): lines between dots of each group of a draw.io XML drawing."""

    def parse(frames):
        import xml.etree.ElementTree as ET

        import pandas as pd

        for frame in frames:
            rows = []
            for text in frame["value"]:
                cells = {c.get("id"): c for c in ET.fromstring(text).iter("mxCell")}
                for c in cells.values():
                    if c.get("edge") == "1" and c.get("source") in cells and c.get("target") in cells:
                        rows.append((cells[c.get("source")].get("parent"), c.get("source"), c.get("target")))
            yield pd.DataFrame(rows, columns=["group", "source", "target"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "group string, source string, target string")


def drawn_gadgets(spark: SparkSession, path: str, locations: int = 3) -> DataFrame:
    """(name, uedges) of the groups of a draw.io XML drawing. A group's dots in reading order are the locations of its
    states, `locations` to a row; each line is an undirected edge. Groups are numbered in reading order of their first dot."""

    def parse(frames):
        import xml.etree.ElementTree as ET

        import pandas as pd

        for frame in frames:
            rows = []
            for text in frame["value"]:
                cells, drawn = list(ET.fromstring(text).iter("mxCell")), []
                for group in cells:
                    if group.get("style") != "group":
                        continue
                    x0, y0 = (round(float(group[0].get(c, 0))) for c in "xy")
                    mine = [c for c in cells if c.get("parent") == group.get("id")]
                    # Drawings are a little off the grid: places count in tens.
                    place = {c.get("id"): tuple((base + int(float(c[0].get(k, 0)))) // 10 for base, k in ((y0, "y"), (x0, "x"))) for c in mine if "ellipse" in c.get("style", "")}
                    number = {dot: divmod(k, locations) for k, dot in enumerate(sorted(place, key=place.get))}
                    lines = [sorted((number[c.get("source")], number[c.get("target")])) for c in mine if c.get("id") not in place]
                    if place:
                        drawn.append((min(place.values()), sorted([s, a, b, t] for (s, a), (t, b) in lines)))
                rows += [(f"drawn_{k}", edges) for k, (_, edges) in enumerate(sorted(drawn, key=lambda d: d[0]))]
            yield pd.DataFrame(rows, columns=["name", "uedges"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "name string, uedges array<array<int>>")


def _naming(definitions: DataFrame, log: bool, schema: str) -> DataFrame:
    def run(frames):
        import pandas as pd

        from ..functions.gadgets import Naming

        for frame in frames:
            rows = []
            for d in frame.itertuples():
                called = "all" if d.all_states else dict(d.state_names) if d.state_names is not None else None
                pragma = list(d.pragma) if d.pragma is not None else []
                made = Naming(d.name, [list(e) for e in d.uedges], [list(e) for e in d.dedges], called, "allow-pruning-named-states" in pragma)
                rows += made.log if log else [(name, k, e) for name, es in made.names.items() for k, e in enumerate(es)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return definitions.where("alias_of is null").mapInPandas(run, schema)


def names_of(definitions: DataFrame) -> DataFrame:
    """(name, position, enc) of all names of definitions, aliases included; a name with several rows is a group.

    An alias names what stands before it. An alias of an unknown name, or that is a name already, is an error.
    """
    own = _naming(definitions, False, "name string, position int, enc binary")
    pairs = [(r["name"], r["alias_of"]) for r in definitions.where("alias_of is not null").select("name", "alias_of").collect()]
    if not pairs:
        return own
    of: dict[str, str] = {}
    for name, target in pairs:
        if name in of:
            raise ValueError(f"alias {name} is a name already")
        of[name] = of.get(target, target)
    table = definitions.sparkSession.createDataFrame(list(of.items()), "alias string, target string")
    known = own.select(F.col("name").alias("n")).distinct()
    for bad, how, message in ((table.join(known, table["alias"] == known["n"], "left_semi"), "alias", "is a name already"), (table.join(known, table["target"] == known["n"], "left_anti"), "target", "is unknown")):
        first = bad.first()
        if first is not None:
            raise ValueError(f"alias {first['alias']}: {first[how]} {message}")
    return own.unionByName(own.join(table, own["name"] == table["target"]).select(F.col("alias").alias("name"), "position", "enc"))


def name_log(definitions: DataFrame) -> DataFrame:
    """(name, base, state, rotation, mirror_rotation) of single names; -1 where the gadget isn't mirrored."""
    return _naming(definitions, True, "name string, base string, state int, rotation int, mirror_rotation int")


def write_log(log: DataFrame, path: str) -> None:
    """One line a name, fields apart by a space."""
    log.write.csv(path, sep=" ")


def names_by_id(named: DataFrame) -> DataFrame:
    """(id, names, groups) from (name, id): names that are the object's alone, and groups it belongs to."""
    members = named.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    listed = lambda alone: F.array_sort(F.collect_set(F.when((F.col("n") == 1) == alone, F.col("name"))))
    return named.distinct().join(members, "name").groupBy("id").agg(listed(F.lit(True)).alias("names"), listed(F.lit(False)).alias("groups"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Definitions from what write_gadgets wrote."""
    read = spark.read.schema("name string, uedges array<array<int>>, dedges array<array<int>>").json(path)
    none = {"pragma": "array<string>", "alias_of": "string", "state_names": "map<int,string>", "all_states": "boolean"}
    return read.select("*", *[F.lit(None).cast(t).alias(c) for c, t in none.items()])


def write_gadgets(named: DataFrame, path: str) -> None:
    """(name, s, a, b, t, directed) as JSON lines {name, uedges, dedges}."""
    edge = F.array("s", "a", "b", "t")
    out = named.groupBy("name").agg(F.array_sort(F.collect_list(F.when(~F.col("directed"), edge))).alias("uedges"), F.array_sort(F.collect_list(F.when(F.col("directed"), edge))).alias("dedges"))
    out.write.json(path)


def dump_text(gadgets: DataFrame, edges: DataFrame, named: DataFrame) -> DataFrame:
    """(id, text) for people, from gadgets with statistics, their edges (id, s, a, b, t, directed) and (name, id)."""
    edge = F.format_string("[%d, %d, %d, %d]", "s", "a", "b", "t")
    nop = (F.col("s") == F.col("t")) & (F.col("a") == F.col("b"))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, edge)))
    lists = edges.groupBy("id").agg(listed(~nop & ~F.col("directed")).alias("u"), listed(~nop & F.col("directed")).alias("d"), listed(nop).alias("p"))
    line = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(f"  {label}: "), F.array_join(c, ", ")))
    head = F.format_string("%d: %d locations, %d states, %d uedges, %d dedges, %d components, %d bytes", "id", "locations", "states", "uedges", "dedges", "components", F.octet_length("enc"))
    joined = gadgets.join(lists, "id", "left").join(names_by_id(named), "id", "left")
    return joined.select("id", F.concat_ws("\n", head, line("names", "names"), line("groups", "groups"), line("undirected edges", "u"), line("directed edges", "d"), line("nop edges", "p")).alias("text"))


def expand_arguments(args: list[str]) -> list[str]:
    """Replace each @file by the arguments in that file, again and again."""
    out = []
    for a in args:
        if a.startswith("@"):
            with open(a[1:], encoding="utf-8") as f:
                out += expand_arguments(f.read().split())
        else:
            out.append(a)
    return out


def provenance_line(kind: str, out: int, in1: int, in2: int | None = None, splice: int | None = None, rotation: int | None = None, point: int | None = None, perm: int | None = None) -> str:
    if kind == "combine":
        return f"{out} = combine {in1} splice {splice} with {in2} rotated {rotation} connect {point} @{perm}"
    return f"{out} = {kind} {in1}" + (f" at {point}" if kind == "connect" else "") + f" @{perm}"


def stats_text(locations: int, states: int, uedges: int, dedges: int) -> str:
    return f"{locations}l{states}s{uedges}u{dedges}d"


def parse_number_list(text: str) -> list[int]:
    return [int(x) for x in re.split(r"[,\s]+", text.strip()) if x]
