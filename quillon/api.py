"""The search service: health, semantic, hybrid and answer requests, as calls and over HTTP.

Encoder, reranker and language model are plain callables that the caller
gives; without them queries take a vector, and answers are extractive.
"""

import json
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import tokens
from quillon.operators import search as S

NO_HITS = "No se encontraron fuentes para responder la consulta."


@dataclass
class SearchService:
    """corpora: a frame (id, parent, text, embedding) by name: jurisprudencia and leyes."""

    corpora: dict[str, DataFrame]
    encoder: Callable[[str], list[float]]
    reranker: Callable[[str, list[str]], list[float]] | None = None
    model: Callable[[str], str] | None = None
    lock: threading.Lock = field(default_factory=threading.Lock)

    def health(self) -> dict:
        """Rows, rows with a vector and parents of each corpus, one pass each."""
        out = {}
        for name, df in self.corpora.items():
            r = df.agg(F.count(F.lit(1)).alias("rows"), F.count("embedding").alias("vectors"), F.countDistinct("parent").alias("parents")).first()
            out[name] = r.asDict() | {"pending": r["rows"] - r["vectors"]}
        return out

    def _encode(self, query: str) -> list[float]:
        if not query or not query.strip():
            raise ValueError("query must not be empty")
        with self.lock:  # encoders are loaded once and not shared between calls
            return list(self.encoder(query))

    def _chosen(self, corpus: str) -> dict[str, DataFrame]:
        if corpus not in S.CORPORA:
            raise ValueError(f"corpus must be one of {', '.join(S.CORPORA)}")
        return {n: df for n, df in self.corpora.items() if corpus in ("ambos", n)}

    def semantic_search(self, query: str, top_k: int = 5, corpus: str = "ambos") -> list[dict]:
        """The best passage of each parent, over one corpus or both."""
        chosen, vector = self._chosen(corpus), self._encode(query)
        parts = [S.best_per_parent(df, vector, "parent", top_k, "id").select("id", "parent", "text", "sim", F.lit(n).alias("corpus")) for n, df in chosen.items()]
        return self._top(parts, "sim", top_k)

    def hybrid_search(self, query: str, top_k_retrieve: int = 10, top_k_final: int = 5, corpus: str = "ambos") -> list[dict]:
        chosen, vector = self._chosen(corpus), self._encode(query)
        terms = next(iter(chosen.values())).sparkSession.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]
        parts = [S.hybrid(df, vector, terms, "parent", "id", k=top_k_retrieve).select("id", "parent", "text", "sim", F.col("hybrid").alias("score"), F.lit(n).alias("corpus")) for n, df in chosen.items()]
        rows = self._top(parts, "score", top_k_retrieve)
        if self.reranker and rows:
            for row, score in zip(rows, self.reranker(query, [r["text"] for r in rows]), strict=True):
                row["rerank"] = float(score)
            rows.sort(key=lambda r: (-r["rerank"], r["id"]))
        return rows[:top_k_final]

    @staticmethod
    def _top(parts: list[DataFrame], by: str, k: int) -> list[dict]:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return [r.asDict() for r in out.orderBy(F.desc(by), "id", "corpus").limit(k).collect()]

    def answer(self, query: str, top_k_retrieve: int = 10, top_k_final: int = 5, corpus: str = "ambos") -> dict:
        """A model's answer from numbered sources; without a model the sources' beginnings."""
        hits = self.hybrid_search(query, top_k_retrieve, top_k_final, corpus)
        if not hits:
            return {"answer": NO_HITS, "sources": []}
        context = "\n\n".join(f"[Fuente {i}] {h['parent']}\n{h['text']}" for i, h in enumerate(hits, 1))
        text = self.model(f"{context}\n\nPregunta: {query}") if self.model else " ".join(f"[{i}] {h['text'][:220]}" for i, h in enumerate(hits[:3], 1))
        return {"answer": text, "sources": hits}


def serve(service: SearchService, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """GET /api/health; POST /api/semantic-search, /api/hybrid-search, /api/llm-search. Bad values 400, unknown paths 404, the rest 500."""
    routes = {"/api/semantic-search": (service.semantic_search, {"query", "top_k", "corpus"}), "/api/hybrid-search": (service.hybrid_search, {"query", "top_k_retrieve", "top_k_final", "corpus"}), "/api/llm-search": (service.answer, {"query", "top_k_retrieve", "top_k_final", "corpus"})}

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: object) -> None:
            raw = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def run(self, call: Callable[[], object]) -> None:
            try:
                self.reply(200, call())
            except ValueError as e:
                self.reply(400, {"error": str(e)})
            except Exception as e:  # noqa: BLE001  the server stays up
                self.reply(500, {"error": type(e).__name__})

        def do_GET(self) -> None:
            if self.path == "/api/health":
                self.run(service.health)
            else:
                self.reply(404, {"error": "not found"})

        def do_POST(self) -> None:
            if self.path not in routes:
                return self.reply(404, {"error": "not found"})
            call, names = routes[self.path]
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))

            def go() -> object:
                body = json.loads(raw or b"{}")
                if not isinstance(body, dict) or "query" not in body:
                    raise ValueError("query is missing")
                return {"results": call(**{k: v for k, v in body.items() if k in names})}

            self.run(go)

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
