"""Map files: text records, a compact binary form, bounds and manifests."""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scalar import annotation_kind

MAGIC, VERSION = b"EQM1", 1
_HEADER, _GROUP, _POINT = struct.Struct("<4sHHII6f"), struct.Struct("<4BI"), struct.Struct("<3f4BHH")


def read_text(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Records of map texts: file, line number, kind, and fields (the last keeps its commas)."""
    lines = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)
    rows = lines.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "record"))
    rows = rows.filter(F.trim("record") != "").withColumn("kind", F.upper(F.substring(F.trim("record"), 1, 1)))
    body = F.trim(F.substr(F.trim("record"), F.lit(2)))
    return rows.select("file", "line", "kind", F.transform(F.split(body, ",", 8), lambda f: F.trim(f)).alias("parts"), F.transform(F.split(body, ","), lambda f: F.trim(f)).alias("fields"))


def segments(records: DataFrame) -> DataFrame:
    """L records: nine numbers; rows that are not are invalid."""
    n = lambda i, t: F.get("fields", F.lit(i)).try_cast(t)
    rows = records.filter("kind = 'L'").select("file", "line", *[n(i, "float").alias(c) for i, c in enumerate(["x1", "y1", "z1", "x2", "y2", "z2"])], *[n(6 + i, "int").alias(c) for i, c in enumerate("rgb")], F.size("fields").alias("n"))
    valid = (F.col("n") == 9) & F.expr("r between 0 and 255 and g between 0 and 255 and b between 0 and 255") & F.expr("x1 + y1 + z1 + x2 + y2 + z2 is not null")
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False))).drop("n")


def points(records: DataFrame) -> DataFrame:
    """P records: three numbers, a colour, a size 1 to 3 and a label that may hold commas."""
    n = lambda i, t: F.get("parts", F.lit(i)).try_cast(t)
    rows = records.filter("kind = 'P'").select("file", "line", *[n(i, "float").alias(c) for i, c in enumerate("xyz")], *[n(3 + i, "int").alias(c) for i, c in enumerate("rgb")], n(6, "int").alias("size"), F.get("parts", F.lit(7)).alias("label"))
    return rows.withColumn("valid", F.coalesce(F.expr("size between 1 and 3 and r between 0 and 255 and g between 0 and 255 and b between 0 and 255 and x + y + z is not null and label is not null"), F.lit(False)))


def bounds(lines: DataFrame, by: list[str]) -> DataFrame:
    """Box of all ends of segments."""
    ends = [F.min(F.least(f"{a}1", f"{a}2")).alias(f"min_{a}") for a in "xyz"] + [F.max(F.greatest(f"{a}1", f"{a}2")).alias(f"max_{a}") for a in "xyz"]
    return lines.groupBy(*by).agg(*ends)


def encode(lines: list[tuple], marks: list[tuple]) -> bytes:
    """Binary form of one map: segments (r, g, b, 6 floats) grouped by ascending colour, then points (x, y, z, r, g, b, size, label)."""
    groups: dict[tuple, list[tuple]] = {}
    for line in lines:
        groups.setdefault(tuple(line[:3]), []).append(tuple(line[3:9]))
    ends = [(line[3 + k], line[4 + k], line[5 + k]) for line in lines for k in (0, 3)] + [tuple(m[:3]) for m in marks] or [(0.0, 0.0, 0.0)]
    box = [f(e[a] for e in ends) for f in (min, max) for a in range(3)]
    out = [_HEADER.pack(MAGIC, VERSION, len(groups), len(lines), len(marks), *box)]
    for colour in sorted(groups):
        out.append(_GROUP.pack(*colour, 0, len(groups[colour])))
        out += [struct.pack("<6f", *s) for s in groups[colour]]
    for *xyz, r, g, b, size, label in marks:
        raw = label.encode()
        out.append(_POINT.pack(*xyz, r, g, b, size, len(raw), 0) + raw + b"\0" * (-len(raw) % 4))
    return b"".join(out)


def decode(data: bytes) -> tuple[list[tuple], list[tuple], str]:
    """Segments, points and an error code ('' if the map is sound); nothing is returned of a broken one."""
    if len(data) < _HEADER.size:
        return [], [], "truncated-header"
    magic, version, n_groups, n_lines, n_points, *_ = _HEADER.unpack_from(data)
    if magic != MAGIC:
        return [], [], "bad-magic"
    if version != VERSION:
        return [], [], "bad-version"
    at, lines, marks = _HEADER.size, [], []
    try:
        for _ in range(n_groups):
            r, g, b, reserved, count = _GROUP.unpack_from(data, at)
            at += _GROUP.size
            if reserved or len(lines) + count > n_lines:
                return [], [], "bad-group"
            for _ in range(count):
                lines.append((r, g, b, *struct.unpack_from("<6f", data, at)))
                at += 24
        for _ in range(n_points):
            *xyz, r, g, b, size, length, reserved = _POINT.unpack_from(data, at)
            at += _POINT.size
            raw = data[at : at + length]
            if reserved or len(raw) < length:
                return [], [], "bad-point"
            marks.append((*xyz, r, g, b, size, raw.decode()))
            at += length + -length % 4
    except (struct.error, UnicodeDecodeError):
        return [], [], "truncated-body"
    if at != len(data) or len(lines) != n_lines:
        return [], [], "bad-length"
    return lines, marks, ""


def encode_maps(lines: DataFrame, by: str) -> DataFrame:
    """One binary map a key, with its digest; a map is one file, so its segments are bounded by the reader's limits."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line")
        rows = [tuple(r) for r in frame[["r", "g", "b", "x1", "y1", "z1", "x2", "y2", "z2"]].itertuples(index=False)]
        return pd.DataFrame({by: [frame[by].iloc[0]], "content": [encode(rows, [])]})

    out = lines.groupBy(by).applyInPandas(run, f"`{by}` {lines.schema[by].dataType.simpleString()}, content binary")
    return out.withColumns({"sha256": F.sha2("content", 256), "bytes": F.octet_length("content").cast("long")})


def decode_maps(files: DataFrame, by: str) -> DataFrame:
    """Segments of binary maps (column content), or one row with the error of a broken one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, data in zip(batch[by], batch["content"], strict=True):
                lines, _, error = decode(bytes(data))
                out += [(key, *map(int, r[:3]), *map(float, r[3:]), error) for r in lines] if lines else [(key, *[None] * 9, error)]
            yield pd.DataFrame(out, columns=[by, "r", "g", "b", "x1", "y1", "z1", "x2", "y2", "z2", "error"]).astype({c: "Int32" for c in "rgb"})

    return files.select(by, "content").mapInPandas(run, f"`{by}` {files.schema[by].dataType.simpleString()}, r int, g int, b int, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, error string")


def sound_manifest(entries: DataFrame) -> DataFrame:
    """Manifest entries that hold together (path, digest, sizes, box); all others are left out."""
    ok = F.col("path").rlike(r"^[a-z0-9_]+-[0-9a-f]{12}\.eqm$") & F.col("sha256").rlike(r"^[0-9a-f]{64}$") & (F.substring("sha256", 1, 12) == F.regexp_extract("path", r"-([0-9a-f]{12})\.eqm$", 1))
    ok = ok & F.col("bytes").between(40, 8 << 20) & (F.col("min_x") <= F.col("max_x")) & (F.col("min_y") <= F.col("max_y"))
    return entries.filter(F.coalesce(ok, F.lit(False)))


#: Annotations a map, the share of a map's extent and the least margin by which they may lie outside it.
MOST_ANNOTATIONS, MARGIN_SHARE, LEAST_MARGIN = 256, 0.25, 64.0


def annotations(marks: DataFrame, boxes: DataFrame | None = None, by: str = "file") -> DataFrame:
    """Portals and lines between zones among a map's points: those of size 3 whose label says so, each once.

    boxes (by, min_x, max_x, min_y, max_y) keeps points near their map only; points of a map without one go. A map
    with more than MOST_ANNOTATIONS fails the query, as it does not fit the manifest.
    """
    # an underscore is a space, minus zero is zero
    label = F.trim(F.regexp_replace(F.translate("label", "_", " "), r"[\s\x00-\x1f\x7f-\x9f]+", " "))
    found = marks.filter("size = 3").withColumn("label", label).withColumn("kind", annotation_kind(F.col("label"))).filter("kind is not null")
    found = found.withColumns({c: F.when(F.col(c) == 0, F.lit(0).cast(found.schema[c].dataType)).otherwise(F.col(c)) for c in "xyz"})
    if boxes is not None:
        found = found.join(boxes.select(by, "min_x", "max_x", "min_y", "max_y"), by)
        for c in "xy":
            margin = F.greatest(F.lit(LEAST_MARGIN), MARGIN_SHARE * (F.col(f"max_{c}") - F.col(f"min_{c}")))
            found = found.filter(F.col(c).between(F.col(f"min_{c}") - margin, F.col(f"max_{c}") + margin))
    once = found.groupBy(by, "kind", F.lower("label").alias("key"), "x", "y", "z").agg(F.min(F.struct("line", "label"))["label"].alias("label"))
    counts = once.groupBy(by).agg(F.count("*").alias("n"))
    checked = counts.withColumn("fits", F.when(F.col("n") <= MOST_ANNOTATIONS, F.lit(True)).otherwise(F.raise_error(F.lit("too many annotations on one map")).cast("boolean")))
    return once.join(checked.filter("fits").select(by), by).select(by, "kind", "label", "x", "y", "z")


def label_key(labels: DataFrame, column: str, name: str) -> DataFrame:
    """labels with a key under which spellings of one destination meet: no marks, accents, articles or words for exits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: batch[column].map(_destination)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in labels.schema if f.name != name)
    return labels.mapInPandas(run, f"{schema}, `{name}` string")


# fixed values: words that stand for an exit, that may lead or end a label, and names of one place
_EXITS = r"zone (?:in out|out in|in|out|line)|zoneline|exit|return|portal|teleport(?:er|ation)?"
_LEADS = [r"^(?:the|a|an)\s+", r"^(?:(?:zone(?: (?:in|out|line))?|zoneline|exit|return|portal|teleport(?:er|ation)?)\s+)?to\s+", r"^(?:the|a|an)\s+", r"\s+(?:zone(?: line)?|zoneline|portal|book)$"]
_ALIASES = {"p o k": "knowledge", "pok": "knowledge", "poknowledge": "knowledge", "plane of knowledge": "knowledge"}


def _destination(label: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", re.sub(r"[\x00-\x1f\x7f]", " ", label or "").strip()[:160]).lower() if not unicodedata.category(c).startswith("M"))
    key = re.sub(r"[^a-z0-9]+", " ", re.sub("[`'’]", "", plain)).strip()
    for pattern in _LEADS:
        key = re.sub(pattern, "", key)
    key = key.strip()
    return "" if re.fullmatch(_EXITS, key) else _ALIASES.get(key, key)
