"""The engine's answers as a web service gives them: a path and its parameters to a status and a JSON text.

respond() needs no server; serve() puts it behind the standard library's.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import functions as F

from tarn.engine import Engine


def _number(params: dict[str, str], name: str, default: int) -> int:
    try:
        return int(params[name])
    except (KeyError, ValueError):
        return default


def _search(engine: Engine, params: dict[str, str]) -> tuple[int, str]:
    if not params.get("q", "").strip():
        return 400, json.dumps({"error": "missing query"})
    row = engine.search_response(
        params["q"], params.get("model", "bm25"), _number(params, "topk", 10), params.get("type", "all"), params.get("expand") == "true", _number(params, "page", 1)
    ).first()
    return 200, row.value


def _suggest(engine: Engine, params: dict[str, str]) -> tuple[int, str]:
    prefix = params.get("prefix", params.get("q", "")).strip()
    return 200, json.dumps([r.word for r in engine.suggest(prefix).collect()], ensure_ascii=False)


def _similar(engine: Engine, params: dict[str, str]) -> tuple[int, str]:
    name = params.get("id", params.get("pmcid", "")).strip()
    if not name:
        return 400, json.dumps({"error": "missing id"})
    found = engine.similar([_as_id(engine, name)], _number(params, "topk", 5)).orderBy("rank")
    if "type" in engine.index.docs.columns:
        found = found.join(engine.index.docs.select("doc_id", "type"), "doc_id").orderBy("rank")
    else:
        found = found.withColumn("type", F.lit(""))
    rows = [{"rank": r["rank"], "doc_id": r.doc_id, "score": round(r.score, 6), "type": r.type or ""} for r in found.collect()]
    return 200, json.dumps({"doc_id": name, "similar": rows}, ensure_ascii=False)


def _as_id(engine: Engine, name: str):
    return name if dict(engine.index.docs.dtypes)["doc_id"] == "string" else int(name)


def _stats(engine: Engine, params: dict[str, str]) -> tuple[int, str]:
    r = engine.stats(_number(params, "top", 12)).first()
    top = [{"word": t.word, "df": t.df} for t in r.top]
    return 200, json.dumps({"terms": r.vocabulary, "docs": r.n_docs, "avg_doc_len": round(r.avgdl, 1), "top_terms": top}, ensure_ascii=False)


def _map(engine: Engine, params: dict[str, str]) -> tuple[int, str]:
    if engine.index.docs.limit(2).count() < 2:
        return 200, json.dumps({"docs": [], "clusters": []})
    points, keywords = engine.document_map(_number(params, "clusters", 4))
    # a picture of the collection: a point per document, as many as a page can show are asked of the engine
    point = F.struct("doc_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "type", "cluster")
    docs = points.orderBy("doc_id").limit(_number(params, "points", 5000)).select(F.to_json(point).alias("v")).collect()
    clusters: dict[int, list[str]] = {}
    for r in keywords.orderBy("cluster", "rank").collect():
        clusters.setdefault(r.cluster, []).append(r.stem)
    out = {"docs": [json.loads(r.v) for r in docs], "clusters": [{"id": c, "keywords": words} for c, words in sorted(clusters.items())]}
    return 200, json.dumps(out, ensure_ascii=False)


def _health(engine: Engine, params: dict[str, str]) -> tuple[int, str]:
    return 200, json.dumps(engine.health())


ROUTES = {"/search": _search, "/suggest": _suggest, "/similar": _similar, "/stats": _stats, "/map": _map, "/health": _health}


def respond(engine: Engine, path: str, params: dict[str, str] | None = None, curve: str | None = None) -> tuple[int, str]:
    """Status and JSON for a path; curve: the precision-recall curves that an evaluation has written, for /prcurve."""
    if path == "/prcurve":
        return (200, curve) if curve is not None else (404, json.dumps({"error": "no curves: run an evaluation first"}))
    if path not in ROUTES:
        return 404, json.dumps({"error": f"no such path: {path}"})
    try:
        return ROUTES[path](engine, params or {})
    except Exception as e:  # noqa: BLE001  a caller gets an answer whatever fails
        return 500, json.dumps({"error": str(e).splitlines()[0] if str(e) else type(e).__name__})


def serve(engine: Engine, port: int = 8080, curve: str | None = None) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            status, body = respond(engine, url.path, dict(parse_qsl(url.query)), curve)
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=UTF-8")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.end_headers()
            self.wfile.write(body.encode())

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
