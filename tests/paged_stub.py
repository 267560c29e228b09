"""A stub of a paged interface for tests: pages of a folder of JSON, every call noted in a file."""

import json
import os
import uuid


class Client:
    def __init__(self):
        self.folder = os.environ["PAGED_STUB"]
        with open(f"{self.folder}/rows.json") as f:
            self.rows = json.load(f)

    def agents(self):
        return list(self.rows)

    def page(self, agent, before):
        name = f"{self.folder}/calls/{agent}-{before}"
        if agent == "shaky" and not os.path.exists(name):
            open(name, "w").close()
            raise ConnectionError("try again")
        open(f"{name}-{uuid.uuid4().hex}", "w").close()
        left = [r for r in self.rows[agent] if before is None or r[0] < before]
        return [tuple(r) for r in sorted(left, reverse=True)[:3]]


def connect():
    return Client()
