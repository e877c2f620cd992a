"""Sums of arrays over the tasks of a barrier stage: gathered addresses, then a ring of sockets.

Only addresses pass the driver (`BarrierTaskContext.allGather`); arrays go from task to task, 2 (N - 1) / N of their size from each,
however many tasks there are. Every task ends with the same bits: each piece is summed along the ring in one order, and the finished
piece is handed round. A task that fails closes its sockets, its neighbours fail with it, and Spark runs the stage again.
"""

from __future__ import annotations

import hmac
import socket
import threading

import numpy as np

TIMEOUT = 600
TOKEN_BYTES = 32


class Ring:
    """One task's place among its stage's. `token`: a secret of the stage, which a neighbour must show first."""

    def __init__(self, context, token: bytes):
        self.rank, self.size = context.partitionId(), len(context.getTaskInfos())
        self.left = self.right = None
        if self.size == 1:
            return
        own = context.getTaskInfos()[self.rank].address.rsplit(":", 1)[0]
        door = socket.create_server(("", 0), backlog=16)
        door.settimeout(TIMEOUT)
        places = context.allGather(f"{own}:{door.getsockname()[1]}")
        host, port = places[(self.rank + 1) % self.size].rsplit(":", 1)
        self.right = socket.create_connection((host, int(port)), TIMEOUT)
        self.right.sendall(token)
        while self.left is None:
            found, _ = door.accept()
            found.settimeout(TIMEOUT)
            if hmac.compare_digest(_exactly(found, TOKEN_BYTES), token):
                self.left = found
            else:
                found.close()
        door.close()
        self.right.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def _pass(self, out: np.ndarray, into: np.ndarray) -> None:
        """Send one piece to the right while one from the left comes in."""
        failed: list[BaseException] = []

        def send() -> None:
            try:
                self.right.sendall(memoryview(out).cast("B"))
            except OSError as error:
                failed.append(error)

        sender = threading.Thread(target=send)
        sender.start()
        _fill(self.left, memoryview(into).cast("B"))
        sender.join()
        if failed:
            raise failed[0]

    def total(self, values: np.ndarray) -> np.ndarray:
        """The sum of all tasks' arrays, which have one size."""
        if self.size == 1:
            return values
        cuts = np.linspace(0, len(values), self.size + 1).astype(int)
        whole = np.array(values, np.float64)
        piece = lambda k: whole[cuts[k % self.size] : cuts[k % self.size + 1]]
        for step in range(self.size - 1):
            mine = piece(self.rank - step - 1)
            come = np.empty_like(mine)
            self._pass(piece(self.rank - step).copy(), come)
            mine += come
        for step in range(self.size - 1):
            self._pass(piece(self.rank + 1 - step).copy(), piece(self.rank - step))
        return whole

    def close(self) -> None:
        for one in (self.left, self.right):
            if one is not None:
                one.close()


def _fill(source: socket.socket, view: memoryview) -> None:
    at = 0
    while at < len(view):
        n = source.recv_into(view[at:])
        if not n:
            raise ConnectionError("a neighbour in the ring is gone")
        at += n


def _exactly(source: socket.socket, n: int) -> bytes:
    data = bytearray(n)
    _fill(source, memoryview(data))
    return bytes(data)
