"""Writer of compound files (version 3): what ``hangul.Compound`` reads."""

from __future__ import annotations

import struct

SECTOR, MINI, CUTOFF = 512, 64, 4096
FREE, END, FAT, DIFAT, NONE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC, 0xFFFFFFFF
IN_HEADER = 109
STREAM, STORAGE, ROOT = 2, 1, 5


class Node:
    def __init__(self, name: str, kind: int, data: bytes = b""):
        self.name, self.kind, self.data = name, kind, data
        self.inner: dict[str, Node] = {}
        self.left = self.right = self.child = NONE
        self.start, self.number = END, 0

    def order(self) -> tuple[int, str]:
        return len(self.name.encode("utf-16-le")), self.name.upper()


def _tree(streams: dict[str, bytes]) -> list[Node]:
    """All entries, the root first; each storage's entries are linked as a balanced search tree."""
    root = Node("Root Entry", ROOT)
    for path, data in streams.items():
        *folders, name = path.split("/")
        at = root
        for f in folders:
            at = at.inner.setdefault(f, Node(f, STORAGE))
        at.inner[name] = Node(name, STREAM, data)
    out = [root]

    def listed(storage: Node) -> None:
        for x in storage.inner.values():
            x.number = len(out)
            out.append(x)
        for x in storage.inner.values():
            listed(x)

    def linked(nodes: list[Node]) -> int:
        if not nodes:
            return NONE
        k = len(nodes) // 2
        nodes[k].left, nodes[k].right = linked(nodes[:k]), linked(nodes[k + 1 :])
        return nodes[k].number

    listed(root)
    for x in out:
        x.child = linked(sorted(x.inner.values(), key=Node.order))
    return out


def _padded(b: bytes, size: int, fill: bytes = b"\0") -> bytes:
    return b + fill * (-len(b) % size)


def build(streams: dict[str, bytes]) -> bytes:
    """A compound file with these streams; storages come from the slashes in their paths."""
    nodes = _tree(streams)
    body: list[bytes] = []
    fat: list[int] = []

    def put(b: bytes) -> int:
        """A chain of sectors with these bytes; where it starts."""
        if not b:
            return END
        first, n = len(fat), -(-len(b) // SECTOR)
        body.append(_padded(b, SECTOR))
        fat.extend([*range(first + 1, first + n), END])
        return first

    mini, mini_fat = bytearray(), []
    for x in nodes:
        if x.kind == STREAM and len(x.data) >= CUTOFF:
            x.start = put(x.data)
        elif x.kind == STREAM and x.data:
            x.start, n = len(mini_fat), -(-len(x.data) // MINI)
            mini += _padded(x.data, MINI)
            mini_fat += [*range(x.start + 1, x.start + n), END]
    root = nodes[0]
    root.start, root.data = put(bytes(mini)), bytes(mini)
    mini_start = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat) + b"\xff" * (-4 * len(mini_fat) % SECTOR))
    entries = []
    for x in nodes:
        name = x.name.encode("utf-16-le")[:62]
        entries.append(name.ljust(64, b"\0") + struct.pack("<HBB3I", len(name) + 2, x.kind, 1, x.left, x.right, x.child) + bytes(36) + struct.pack("<IQ", x.start if x.kind != STORAGE else 0, len(x.data)))
    unused = bytes(68) + struct.pack("<3I", NONE, NONE, NONE) + bytes(48)
    directory = put(b"".join(entries + [unused] * (-len(entries) % 4)))
    # Sectors of the table itself, and of the list of these, count in it too.
    n_fat = n_difat = 0
    while True:
        more = -(-(len(fat) + n_fat + n_difat) // (SECTOR // 4)), -(-max(0, n_fat - IN_HEADER) // (SECTOR // 4 - 1))
        if more == (n_fat, n_difat):
            break
        n_fat, n_difat = more
    at = len(fat)
    own = list(range(at, at + n_fat))
    lists = list(range(at + n_fat, at + n_fat + n_difat))
    fat += [FAT] * n_fat + [DIFAT] * n_difat
    fat += [FREE] * (n_fat * SECTOR // 4 - len(fat))
    body.append(struct.pack(f"<{len(fat)}I", *fat))
    rest = own[IN_HEADER:]
    for k in range(n_difat):
        part = rest[k * 127 : (k + 1) * 127]
        body.append(struct.pack("<128I", *part, *[FREE] * (127 - len(part)), lists[k + 1] if k + 1 < n_difat else END))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<9I", 0, n_fat, directory, 0, CUTOFF, mini_start, -(-4 * len(mini_fat) // SECTOR), lists[0] if lists else END, n_difat)
    head += struct.pack(f"<{IN_HEADER}I", *own[:IN_HEADER], *[FREE] * (IN_HEADER - len(own[:IN_HEADER])))
    return head + b"".join(body)
