"""Commands over a store: ``python -m veilframe VERB --store PATH ...``; submit it to a cluster as any Spark program.

The password is taken from ``VEILFRAME_PASSWORD``, else asked for.  Exit codes: 0 done, 1 a file
could not be read or the command failed, 2 a file was blocked or a leak found, 3 not fully restored.
"""

from __future__ import annotations

import argparse
import getpass
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import api, publish
from veilframe.operators.masking import references
from veilframe.operators.rules import KINDS
from veilframe.session import stored
from veilframe.sources.documents import read_documents
from veilframe.sources.store import Store, StoreError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veilframe")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, **flags: dict) -> None:
        p = verbs.add_parser(name)
        p.add_argument("--store", required=True)
        for flag, how in flags.items():
            p.add_argument(flag if how.get("nargs") == "?" or how.pop("bare", False) else f"--{flag.replace('_', '-')}", **how)

    value, switch = {"required": True}, {"action": "store_true"}
    verb("init")
    verb("rekey")
    verb("glossary", action={"bare": True, "choices": ["add", "list", "remove"]}, term={"nargs": "?"}, kind={"default": "ALTRO", "choices": KINDS}, alias={"action": "append", "default": []})
    verb("allow", action={"bare": True, "choices": ["add", "list", "remove"]}, value={"nargs": "?"})
    verb("anonymize", source={"bare": True}, out=value, recursive=dict(switch), force=dict(switch), dry_run=dict(switch), exclude={"action": "append", "default": []}, json=dict(switch))
    verb("verify", source={"bare": True}, recursive=dict(switch))
    verb("restore", source={"bare": True}, out=value, recursive=dict(switch))
    return top


def password(prompt: str = "Password: ", name: str = "VEILFRAME_PASSWORD") -> str:
    given = os.environ.get(name)
    if given is None:
        if not sys.stdin.isatty():
            raise StoreError(f"no terminal to ask for a password; set {name}")
        given = getpass.getpass(prompt)
    if not given:
        raise StoreError("an empty password is refused")
    return given


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb in ("glossary", "allow") and args.action != "list" and not (args.term if args.verb == "glossary" else args.value):
        parser().error("name what to add or remove")
    if args.verb == "anonymize" and args.dry_run and args.force:
        parser().error("--dry-run and --force exclude each other")
    spark = spark or SparkSession.builder.appName("veilframe").getOrCreate()
    try:
        if args.verb == "init":
            Store.create(spark, args.store, password())
            return 0
        store = Store.open(spark, args.store, password())
        return {"rekey": _rekey, "glossary": _glossary, "allow": _allow, "anonymize": _anonymize, "verify": _verify, "restore": _restore}[args.verb](spark, store, args)
    except (StoreError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
    except KeyError as e:
        print(f"error: {e.args[0]!r} is not there", file=sys.stderr)
    return 1


def _rekey(spark: SparkSession, store: Store, args: argparse.Namespace) -> int:
    store.rekey(password("New password: ", "VEILFRAME_NEW_PASSWORD"))
    return 0


def _show(rows: DataFrame) -> int:
    for row in rows.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))
    return 0


def _glossary(spark: SparkSession, store: Store, args: argparse.Namespace) -> int:
    now = store.table("glossary")
    if args.action == "list":
        return _show(now.select("term", "kind", F.concat_ws(", ", "aliases")).orderBy("term"))
    added = spark.createDataFrame([(args.term or "", args.kind, args.alias)], now.schema)
    store.save(glossary=api.upsert_term(now, added) if args.action == "add" else api.remove_term(now, args.term))
    return 0


def _allow(spark: SparkSession, store: Store, args: argparse.Namespace) -> int:
    now = store.table("allowlist")
    if args.action == "list":
        return _show(now.orderBy("value"))
    store.save(allowlist=(api.allow if args.action == "add" else api.disallow)(now, args.value))
    return 0


def _anonymize(spark: SparkSession, store: Store, args: argparse.Namespace) -> int:
    got = publish.mask_folder(
        spark, args.source, args.out, store.table("mapping"), args.recursive, args.force, args.dry_run, glossary=store.table("glossary"), allowlist=store.table("allowlist"),
        exclude=tuple(args.exclude), before=lambda mapping: store.save(mapping=mapping),
    )
    if args.json:
        counts = {r["status"]: r["count"] for r in publish.summary(got.files).collect()}
        print(json.dumps({"files": [json.loads(x) for x in got.files.orderBy("path").toJSON().toLocalIterator()], "summary": counts}))
    else:
        _show(got.files.orderBy("path"))
        _show(got.notes.orderBy("path", "note"))
    for row in got.leaks.select("name", "text", "reason").orderBy("name", "start").toLocalIterator():
        print(f"{row['name']}: {row['text']!r}: {row['reason']}", file=sys.stderr)
    return publish.exit_code(got.files)


def _verify(spark: SparkSession, store: Store, args: argparse.Namespace) -> int:
    rows = stored(read_documents(spark, args.source, args.recursive, results=True), "segments")
    left = api.verify(rows.where("error is null").select(F.struct("path", "seg_id").alias("place"), "text"), store.table("mapping"), store.table("glossary"), store.table("allowlist"), key="place", text="text")
    left = stored(left, "left")
    _show(left.select("place.path", "place.seg_id", "text", "reason").orderBy("path", "seg_id"))
    unread = rows.where("error is not null")
    _show(unread.select("path", "error"))
    return 2 if left.limit(1).count() else int(unread.limit(1).count() > 0)


def _restore(spark: SparkSession, store: Store, args: argparse.Namespace) -> int:
    mapping = store.table("mapping")
    publish.restore_folder(spark, args.source, args.out, mapping, args.recursive)
    rows = read_documents(spark, args.source, args.recursive, results=True).where("error is null")
    refs = rows.select("path", F.explode(references(F.col("text"))).alias("r")).select("path", "r.raw", "r.kind", "r.number")
    invented = stored(refs.join(mapping, ["kind", "number"], "left_anti").select("path", "raw").distinct(), "invented")
    _show(invented.orderBy("path", "raw"))
    return 3 if invented.limit(1).count() else 0


if __name__ == "__main__":
    sys.exit(main())
