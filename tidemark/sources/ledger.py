"""A ledger of requests: what was asked and what was answered, one small file each, kept outside the job.

A request is named by a digest of its content. It is noted before it is sent and its answer is kept before the
task goes on, so a task that runs again, in this job or a later one, asks for nothing that has an answer. A
request that was noted and has no answer was lost on its way: it counts as sent and as failed, and asking
again is a new request, with the next attempt's number. Tasks that run twice at the same time
(speculation) must be off, else both may send.

The folder must be open to all tasks through a file system of pyarrow.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from .hourly import opened

FAILED, INVALID, EXHAUSTED = "model-request-failed", "model-response-invalid", "model-budget-exhausted"


class ResponseError(Exception):
    """To be raised by a provider that got an answer it can't read."""


def request_key(content: Any) -> str:
    return hashlib.sha256(json.dumps(content, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


class Ledger:
    def __init__(self, folder: str):
        self.store, self.root = opened(folder.rstrip("/"))
        self.store.create_dir(self.root, recursive=True)

    def _at(self, key: str, kind: str) -> str:
        return f"{self.root}/{key}.{kind}"

    def _there(self, path: str) -> bool:
        from pyarrow import fs

        return self.store.get_file_info(path).type == fs.FileType.File

    def _put(self, path: str, value: Any) -> None:
        """Whole or not at all."""
        fresh = f"{self.root}/.{uuid.uuid4().hex}"
        with self.store.open_output_stream(fresh) as out:
            out.write(json.dumps(value).encode())
        self.store.move(fresh, path)

    def answer(self, key: str) -> dict | None:
        """{"answers": ...} or {"failure": ...}; a request without an answer is a failure; None if it was never sent."""
        if self._there(self._at(key, "answer")):
            with self.store.open_input_stream(self._at(key, "answer")) as file:
                return json.loads(file.read())
        return {"failure": FAILED} if self._there(self._at(key, "asked")) else None

    def ask(self, key: str, content: Any, send) -> dict:
        """The kept answer, or that of ``send()``, which is called at most once for a key."""
        known = self.answer(key)
        if known is not None:
            return known
        self._put(self._at(key, "asked"), content)
        found = asked(send)
        self._put(self._at(key, "answer"), found)
        return found


def asked(send) -> dict:
    """What came of a request: answers in their strict form, or the code of a failure."""
    try:
        answers = send()
    except ResponseError:
        return {"failure": INVALID}
    except Exception:
        return {"failure": FAILED}
    return {"answers": strict(answers)} if isinstance(answers, list | tuple) else {"failure": INVALID}


def strict(answers: list) -> list[dict]:
    """Items with a whole number as id. One that isn't exactly id, decision and evidence, both texts, keeps the id only."""
    out = []
    for item in answers:
        if not isinstance(item, dict) or not isinstance(item.get("id"), int) or isinstance(item["id"], bool):
            continue
        good = item.keys() == {"id", "decision", "evidence"} and isinstance(item["decision"], str) and isinstance(item["evidence"], str)
        out.append({"id": item["id"], "decision": item["decision"] if good else None, "evidence": item["evidence"] if good else None})
    return out
