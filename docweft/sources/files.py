"""Readers and writers of the file formats around a chunk corpus."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from docweft.functions import text as T
from docweft.operators import chunking
from docweft.operators.gates import GateError, require_fingerprint
from docweft.session import ships

# The headers of chunk dumps and of review packets.
DUMP_HEADER = r"\[(\d+)\] source=(\S+) type=(\S+) page=(\d+) len=(\d+) tokens=(\d+)"
STAMP = "# corpus_fingerprint:"
PACKET_HEADER = r"### (Q\d+) — (\S+)"
PACKET_BOX = r"\[( |x|X)\]\s+(CORRECT|UNGROUNDED|WRONG|LABEL ISSUE)"
PACKET_VERDICT = r"\*\*Layer A verdict:\*\* (\S+)"
RULE = "-" * 78

QUESTION = t.StructType([
    t.StructField("id", t.StringType()), t.StructField("question", t.StringType()), t.StructField("answer", t.StringType()), t.StructField("stratum", t.StringType()),
    t.StructField("gold_chunks", t.ArrayType(t.LongType())), t.StructField("_evidence", t.StructType([t.StructField("tier", t.StringType()), t.StructField("matched", t.StringType())])),
    t.StructField("origin", t.StringType()), t.StructField("label_status", t.StringType()), t.StructField("why_absent", t.StringType()), t.StructField("notes", t.StringType()),
])


def expand_paths(paths: list[str], suffix: str = ".pdf") -> list[str]:
    """Files, and all files with the suffix below folders, resolved, sorted and without repeats; fatal on missing, wrong or no files."""
    out: set[str] = set()
    for p in map(Path, paths):
        if p.is_dir():
            out |= {str(f.resolve()) for f in p.rglob(f"*{suffix}")}
        elif not p.exists():
            raise FileNotFoundError(str(p))
        elif p.suffix.lower() != suffix:
            raise ValueError(f"{p} is no {suffix} file")
        else:
            out.add(str(p.resolve()))
    if not out:
        raise ValueError(f"no {suffix} files")
    return sorted(out)


def read_binary(spark: SparkSession, paths: list[str], glob: str = "*") -> DataFrame:
    """``path, content, sha256``, one row per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths)
    return files.dropDuplicates(["path"]).select("path", "content", T.fingerprint(F.col("content")).alias("sha256"))


def extract_lines(files: DataFrame, parser, schema: str = "path string, page int, line_no int, line string") -> DataFrame:
    """Lines of documents by an injected ``parser(bytes) -> [(page, line)]``, run on the executors; furniture and empty lines are dropped."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(p, page, i, line) for p, c in zip(b["path"], b["content"]) for i, (page, line) in enumerate(parser(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "page", "line_no", "line"])

    return chunking.clean_lines(files.select("path", "content").mapInPandas(run, schema))


def pdf_parser(content: bytes) -> list[tuple[int, str]]:
    """Pages and lines of a PDF, where the optional parser is installed."""
    try:
        import io

        import pdfplumber
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pdfplumber") from e
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [(i, line) for i, page in enumerate(pdf.pages, 1) for line in (page.extract_text() or "").split("\n")]


def plain_parser(content: bytes) -> list[tuple[int, str]]:
    """Plain text with form feeds between pages."""
    return [(i, line) for i, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1) for line in page.split("\n")]


def parse_dump(whole: DataFrame, text: str = "value") -> DataFrame:
    """Chunks of whole dump texts: ``chunk_pos, doc, kind, page, n_chars, n_tokens, text``; texts are byte for byte, less the one blank line that parts chunks."""
    cut = F.split(F.col(text), rf"(?m)^(?=(?:-{{78}}\n)?{DUMP_HEADER})")
    rec = whole.select(F.explode(cut).alias("r")).where(F.col("r").rlike(rf"(?m)^{DUMP_HEADER}"))
    g = lambda i: F.regexp_extract("r", rf"(?m)^{DUMP_HEADER}", i)
    body = F.regexp_extract("r", rf"(?s){DUMP_HEADER}[^\n]*\n-{{3,}}[^\n]*\n(.*)$", 7)
    rec = rec.select(g(1).cast("long").alias("chunk_pos"), g(2).alias("doc"), g(3).alias("kind"), g(4).cast("int").alias("page"), g(5).cast("int").alias("n_chars"), g(6).cast("int").alias("n_tokens"), body.alias("text"))
    return rec.withColumn("text", F.regexp_replace("text", r"\n-{78}\n?\z", "\n")).withColumn("text", F.regexp_replace("text", r"\n\n?\z", ""))


def read_dump(spark: SparkSession, path: str, source: str | None = None, gate: bool = True) -> DataFrame:
    """A dump's chunks, after its stamp was found to agree with them; only then is ``source`` filtered."""
    chunks = parse_dump(spark.read.text(path, wholetext=True))
    if gate:
        require_fingerprint(chunking.corpus_fingerprint(chunks).first()["fingerprint"], read_stamp(spark, path), path)
    return chunks if source is None else chunks.where(F.col("doc") == source)


def read_legacy_dump(spark: SparkSession, path: str, source: str = "") -> DataFrame:
    """The older reading: texts trimmed, long rules removed, and a source that only needs to contain ``source``."""
    text = F.trim(F.regexp_replace("text", r"(?m)^[-#]{20,}$", ""))
    return parse_dump(spark.read.text(path, wholetext=True)).withColumn("text", T.squeeze_ends(text)).where(F.col("doc").contains(source))


def read_stamp(spark: SparkSession, path: str) -> str:
    """The fingerprint in a dump's leading comment lines, else an empty string."""
    for row in spark.read.text(path).take(20):
        if row[0].startswith(STAMP):
            return row[0][len(STAMP):].strip()
        if not row[0].startswith("#"):
            break
    return ""


def chunk_map(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_pos", "text")


def dump_lines(chunks: DataFrame) -> DataFrame:
    """``chunk_pos, record``: every chunk as it stands in a dump."""
    head = F.concat(F.lit("["), F.col("chunk_pos").cast("string"), F.lit("] source="), F.col("doc"), F.lit(" type="), F.col("kind"), F.lit(" page="), F.coalesce(F.col("page").cast("string"), F.lit("0")),
                    F.lit(" len="), F.length("text").cast("string"), F.lit(" tokens="), T.token_estimate(F.col("text")).cast("string"))
    return chunks.select("chunk_pos", F.concat(F.lit(RULE + "\n"), head, F.lit("\n" + RULE + "\n"), F.col("text"), F.lit("\n")).alias("record"))


def write_dump(chunks: DataFrame, path: str) -> str:
    """Write a dump file for people and tools, stamped; returns its fingerprint.  Rows stream through the driver in order."""
    stamp = chunking.corpus_fingerprint(chunks).first()["fingerprint"]
    tmp = Path(path + ".tmp")
    with tmp.open("w", encoding="utf-8") as f:
        f.write(f"# chunk dump\n{STAMP} {stamp}\n\n")
        for row in dump_lines(chunks).orderBy("chunk_pos").toLocalIterator():
            f.write(row["record"] + "\n")
    tmp.replace(path)
    return stamp


def read_questions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Questions of several JSON files, in file order: ``file_no, question_no`` and the question's fields."""
    out = None
    schema = t.StructType([t.StructField("questions", t.ArrayType(QUESTION))])
    for i, p in enumerate(paths):
        one = spark.read.schema(schema).json(p, multiLine=True).select(F.lit(i).alias("file_no"), F.posexplode("questions").alias("question_no", "q")).select("file_no", "question_no", "q.*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no question files")
    return out.withColumnRenamed("_evidence", "evidence")


def read_gold_map(spark: SparkSession, path: str) -> DataFrame:
    """``chunk_pos, chunk_id`` of a JSON object from positions to stable ids."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    return m.select(F.col("k").cast("long").alias("chunk_pos"), F.col("v").alias("chunk_id"))


def read_jsonl(spark: SparkSession, path: str, schema: t.StructType | str, lenient: bool = False) -> DataFrame:
    """JSON lines with a given schema, blank lines left out.  A broken line is fatal, unless ``lenient``, as when a run resumes."""
    if not lenient:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    s = t._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = t.StructType([*s.fields, t.StructField("_corrupt_record", t.StringType())])
    return spark.read.schema(wide).json(path, mode="PERMISSIVE").cache().where("_corrupt_record is null").drop("_corrupt_record")


def append_jsonl(df: DataFrame, done: DataFrame | None, path: str, key: str = "id") -> None:
    """Append the records that are not done yet."""
    rest = df if done is None else df.join(done.select(key).distinct(), key, "left_anti")
    rest.write.mode("append").json(path)


def parse_packets(whole: DataFrame, text: str = "value") -> DataFrame:
    """``id, stratum, a_verdict, human_verdict, n_boxes, n_ticked`` of the blocks of whole review packets; text before the first block is none."""
    block = whole.select(F.explode(F.split(text, rf"(?m)^(?={PACKET_HEADER}\s*$)")).alias("r")).where(F.col("r").rlike(rf"^{PACKET_HEADER}\s*\n"))
    boxes = F.arrays_zip(F.regexp_extract_all("r", F.lit(PACKET_BOX), F.lit(1)).alias("mark"), F.regexp_extract_all("r", F.lit(PACKET_BOX), F.lit(2)).alias("name"))
    ticked = F.filter(boxes, lambda b: b["mark"] != " ")
    return block.select(F.regexp_extract("r", PACKET_HEADER, 1).alias("id"), F.regexp_extract("r", PACKET_HEADER, 2).alias("stratum"), F.regexp_extract("r", PACKET_VERDICT, 1).alias("a_verdict"),
                        F.get(ticked, F.lit(0))["name"].alias("human_verdict"), F.size(boxes).alias("n_boxes"), F.size(ticked).alias("n_ticked"))


def read_packet(spark: SparkSession, path: str) -> DataFrame:
    """People's verdicts; fatal if there is no block, or one lacks its verdict line or does not have four boxes with exactly one ticked."""
    found = parse_packets(spark.read.text(path, wholetext=True))
    bad = found.where("a_verdict = '' or n_boxes <> 4 or n_ticked <> 1").take(3)
    if bad or not found.take(1):
        raise ValueError(f"malformed packet: {bad or 'no question blocks'}")
    return found.select("id", "stratum", "a_verdict", "human_verdict")


def migration_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """``chunk_pos, chunk_id`` from old positions to new ids, by place; fatal if any text differs."""
    w = W.partitionBy("doc").orderBy("chunk_pos")
    a = old.select("doc", "chunk_pos", F.col("text").alias("old_text"), (F.row_number().over(w) - 1).alias("ordinal"))
    j = a.join(new.select("doc", "ordinal", "chunk_id", "text"), ["doc", "ordinal"], "full_outer")
    bad = j.where(~F.col("old_text").eqNullSafe(F.col("text"))).take(3)
    if bad:
        raise GateError(f"texts differ, nothing is mapped: {bad}")
    return j.select("chunk_pos", "chunk_id")


def questions_with_labels(questions: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """One JSON record per labelled question."""
    j = questions.join(labels.where("tier <> 'ABSTAIN'"), key)
    return j.select(F.to_json(F.struct(F.col(key), "question", "answer", "stratum", F.col("chunks").alias("gold_chunks"), F.struct("tier", "matched").alias("_evidence"))).alias("value"))


ships(__name__)
