"""``python -m docweft.cli ingest PATH... | ask QUESTION``.  Exit codes: 0 done, 2 wrong input, 3 empty index, 4 no model."""

from __future__ import annotations

import argparse
import sys

from docweft.engine import EmptyIndex, Engine
from docweft.operators.gates import GateError
from docweft.sources.models import HttpClient, ModelMissing


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--index-dir", default=argparse.SUPPRESS)
    p = argparse.ArgumentParser(prog="docweft", parents=[shared])
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest", parents=[shared])
    i.add_argument("paths", nargs="+")
    i.add_argument("--budget", type=int, default=400)
    a = sub.add_parser("ask", parents=[shared])
    a.add_argument("question")
    a.add_argument("-k", type=int, default=3)
    a.add_argument("--host", help="chat server; without it the best passage is quoted")
    a.add_argument("--model", default="")
    a.add_argument("--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from docweft.session import local_session

    spark = spark or local_session()
    root = getattr(args, "index_dir", "index")
    try:
        if args.command == "ingest":
            s = Engine(spark, root, budget=args.budget).ingest_paths(args.paths, print)
            print(f"{s.n_newly_indexed} of {s.n_files} documents are new; {s.stats['n_documents']} documents, {s.stats['n_chunks']} chunks")
            return 0
        host, model = args.host, args.model
        engine = Engine(spark, root, **({"make_client": lambda: HttpClient(host, model)} if host else {}))
        q = spark.createDataFrame([("q", args.question)], "query_id string, question string")
        row = engine.answers(q, args.k).first()
        print(row["answer"])
        if row["abstained"]:
            print("no answer in the documents; nearest: " + ("; ".join(row["near_misses"] or []) or "nothing"))
        else:
            print("sources: " + "; ".join(row["sources"] or []))
        if args.verbose:
            print(f"{row['seconds']:.2f} s" + (f", {row['tokens_per_second']} tokens/s" if row["tokens_per_second"] is not None else ""))
            engine.search(q, args.k).select("place", "slot", "bm25_rank", "dense_place", "rrf_score", "filename", "page").orderBy("place").show()
        return 0
    except EmptyIndex as e:
        print(e, file=sys.stderr)
        return 3
    except ModelMissing as e:
        print(e, file=sys.stderr)
        return 4
    except (FileNotFoundError, ValueError, GateError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
