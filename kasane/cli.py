"""Command line for the data verbs: inventory, build, validate, lookup, search, document."""

from __future__ import annotations

import argparse
import json
import sys

from kasane.errors import QueryError
from kasane.runtime import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kasane")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("inventory", "build"):
        v = sub.add_parser(verb)
        v.add_argument("root"), v.add_argument("release_id"), v.add_argument("out")
    for verb in ("validate", "info"):
        sub.add_parser(verb).add_argument("store")
    v = sub.add_parser("lookup")
    v.add_argument("store"), v.add_argument("scheme"), v.add_argument("code")
    v.add_argument("--edition"), v.add_argument("--version"), v.add_argument("--language", default="ja")
    v = sub.add_parser("search")
    v.add_argument("store"), v.add_argument("query")
    v.add_argument("--language", default="ja"), v.add_argument("--limit", type=int, default=20)
    for verb in ("parents", "children"):
        v = sub.add_parser(verb)
        v.add_argument("store"), v.add_argument("scheme"), v.add_argument("code"), v.add_argument("--edition"), v.add_argument("--language", default="ja")
    v = sub.add_parser("export")
    v.add_argument("store"), v.add_argument("target"), v.add_argument("policy"), v.add_argument("--base-url", default="https://example.invalid")
    v = sub.add_parser("audit")
    v.add_argument("first"), v.add_argument("second")
    sub.add_parser("doctor").add_argument("store")
    v = sub.add_parser("document")
    v.add_argument("store"), v.add_argument("document_id")
    v.add_argument("--page", type=int), v.add_argument("--section")
    return p


def doctor(spark, path: str) -> list[dict]:
    """What a store needs to answer: every check runs, whatever the others say."""
    from kasane.api import Store
    from kasane.runtime import shared_folder
    from kasane.sources.build import resolve

    state: dict = {}

    def opened():
        state["store"] = Store(spark, path)
        return f"{len(state['store'].t)} tables"

    tests = {
        "store path": lambda: resolve(path), "scratch folder": lambda: shared_folder(spark), "tables": opened, "release": lambda: state["store"].release()["release_id"],
        "attribution": lambda: len(state["store"].t["release_source"].first().attribution), "concepts": lambda: state["store"].t["concept"].count(),
        "search": lambda: state["store"].search("ab", limit=1)["search_mode"],
    }
    out = []
    for name, test in tests.items():
        try:
            out.append({"check": name, "ok": True, "value": str(test())})
        except Exception as gone:
            out.append({"check": name, "ok": False, "value": f"{type(gone).__name__}: {gone}"[:200]})
    return out


def run(spark, a: argparse.Namespace) -> tuple[object, int]:
    from kasane.api import Store
    from kasane.operators.quality import package_checks, store_checks
    from kasane.sources import build, export, package

    if a.verb == "inventory":
        files = package.inventory(spark, a.root, a.release_id)
        package.write_inventory(files, a.out)
        return {"files": files.count()}, 0
    if a.verb == "build":
        return {"store": build.build_store(spark, a.root, a.release_id, a.out)}, 0
    if a.verb == "audit":
        found = export.audit(spark, a.first, a.second)
        return found, int(not found["equal"])
    if a.verb == "doctor":
        found = doctor(spark, a.store)
        return {"checks": found}, int(not all(c["ok"] for c in found))
    store = Store(spark, a.store)
    if a.verb == "export":
        return export.export(store, a.target, a.policy, a.base_url), 0
    if a.verb in ("parents", "children"):
        return getattr(store, a.verb)(a.scheme, a.code, edition=a.edition, language=a.language), 0
    if a.verb == "validate":
        date = store.release()["reference_date"]
        rows = [r.asDict() for r in store_checks(store.t).unionByName(package_checks(store.t, date, build.TABLES)).collect()]
        return {"valid": all(r["match"] for r in rows), "checks": rows}, int(not all(r["match"] for r in rows))
    if a.verb == "info":
        return store.release_info(), 0
    if a.verb == "lookup":
        record = store.lookup(a.scheme, a.code, edition=a.edition, language=a.language, version=a.version)
        return record, int("exact" not in record["match_status"])
    if a.verb == "search":
        return store.search_all(a.query, language=a.language, limit=a.limit), 0
    return store.get_document(a.document_id, a.page, a.section), 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        value, status = run(build_session(), a)
    except QueryError as bad:
        value, status = {"error": bad.code, "message": bad.message}, 1
    json.dump(value, sys.stdout, ensure_ascii=False, default=str)
    print()
    return status


if __name__ == "__main__":
    sys.exit(main())
