"""Compound files, and the Outlook messages in them, by the published formats of either."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator
from email.message import EmailMessage
from email.policy import default

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
#: The end of a chain of sectors; greater numbers stand for no sector (fixed value).
LAST = 0xFFFFFFFA
#: Tags of a message's properties (fixed values of the format).
SUBJECT, BODY, HTML, SENDER_NAME, SENDER_MAIL, SENDER_SMTP, SHOWN_TO, SHOWN_CC, SHOWN_BCC = 0x0037, 0x1000, 0x1013, 0x0C1A, 0x0C1F, 0x5D01, 0x0E04, 0x0E03, 0x0E02
SUBMITTED, DELIVERED, RECIPIENT_KIND, NAME, SMTP_ADDRESS, ADDRESS = 0x0039, 0x0E06, 0x0C15, 0x3001, 0x39FE, 0x3003
DATA, LONG_NAME, SHORT_NAME, MEDIA_TYPE, CONTENT_ID = 0x3701, 0x3707, 0x3704, 0x370E, 0x3712


class Compound:
    """The storages and streams of a compound file. ``tree`` maps each storage's children: name → bytes of a stream, or the tree of a storage."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        tables, directory, self.cutoff, mini_table = (struct.unpack_from("<I", data, at)[0] for at in (44, 48, 56, 60))
        more, self.size, self.mini_size = struct.unpack_from("<I", data, 68)[0], 1 << shift, 1 << mini_shift
        if shift not in (9, 12) or mini_shift >= shift:
            raise ValueError("unknown sector size")
        places = list(struct.unpack_from("<109I", data, 76))
        seen: set[int] = set()
        while more < LAST and more not in seen:
            seen.add(more)
            part = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            places += part[:-1]
            more = part[-1]
        self.next = [n for p in places[:tables] if p < LAST for n in struct.unpack(f"<{self.size // 4}I", self._sector(p))]
        raw = self._chain(directory)
        self.entries = [raw[at : at + 128] for at in range(0, len(raw) - 127, 128)]
        table = self._chain(mini_table) if mini_table < LAST else b""
        self.mini_next = list(struct.unpack(f"<{len(table) // 4}I", table))
        start, size = self._place(self.entries[0])
        self.mini = self._chain(start)[:size] if size else b""
        self.tree = self._children(self.entries[0], 0)

    def _sector(self, n: int) -> bytes:
        part = self.data[(n + 1) * self.size : (n + 2) * self.size]
        return part + bytes(self.size - len(part))

    def _chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < LAST:
            if start in seen or start >= len(self.next):
                raise ValueError("broken chain of sectors")
            seen.add(start)
            out.append(self._sector(start))
            start = self.next[start]
        return b"".join(out)

    @staticmethod
    def _place(entry: bytes) -> tuple[int, int]:
        return struct.unpack_from("<I", entry, 116)[0], struct.unpack_from("<Q", entry, 120)[0] & 0xFFFFFFFF

    def _stream(self, entry: bytes) -> bytes:
        start, size = self._place(entry)
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < LAST and size > len(out) * self.mini_size:
            if start in seen or start >= len(self.mini_next):
                raise ValueError("broken chain of sectors")
            seen.add(start)
            out.append(self.mini[start * self.mini_size : (start + 1) * self.mini_size])
            start = self.mini_next[start]
        return b"".join(out)[:size]

    def _children(self, storage: bytes, depth: int) -> dict:
        if depth > 32:
            raise ValueError("storages too deep")
        out: dict = {}
        waiting, seen = [struct.unpack_from("<I", storage, 76)[0]], set()
        while waiting:
            n = waiting.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            e = self.entries[n]
            left, right = struct.unpack_from("<II", e, 68)
            waiting += [left, right]
            name = e[: max(0, min(64, struct.unpack_from("<H", e, 64)[0]) - 2)].decode("utf-16-le", "replace")
            out[name] = self._children(e, depth + 1) if e[66] == 1 else self._stream(e)
        return out


def _text(tree: dict, tag: int) -> str:
    for kind, encoding in (("001F", "utf-16-le"), ("001E", "cp1252")):
        raw = tree.get(f"__substg1.0_{tag:04X}{kind}")
        if isinstance(raw, bytes):
            return raw.decode(encoding, "replace").rstrip("\0")
    return ""


def _fixed(tree: dict, tag: int, head: int) -> bytes | None:
    """The eight bytes of a property of fixed size."""
    raw = tree.get("__properties_version1.0", b"")
    for at in range(head, len(raw) - 15, 16):
        if struct.unpack_from("<I", raw, at)[0] >> 16 == tag:
            return raw[at + 8 : at + 16]
    return None


def _one_line(text: str) -> str:
    return " ".join(text.split())


def message(tree: dict, top: bool = True) -> EmailMessage:
    """An Outlook message as a mail: its headers, bodies and attachments. Messages inside it are mails inside the mail."""
    out = EmailMessage(policy=default.clone(utf8=True))
    name, mail = _text(tree, SENDER_NAME), _text(tree, SENDER_SMTP) or _text(tree, SENDER_MAIL)
    people: dict[int, list[str]] = {1: [], 2: [], 3: []}
    for part in sorted(k for k in tree if k.startswith("__recip_version1.0_")):
        r = tree[part]
        kind = _fixed(r, RECIPIENT_KIND, 8)
        shown, address = _one_line(_text(r, NAME)), _text(r, SMTP_ADDRESS) or _text(r, ADDRESS)
        people.setdefault(struct.unpack_from("<I", kind)[0] if kind else 1, []).append(f"{shown} <{address}>" if shown and address and shown != address else address or shown)
    heads = {"From": f"{_one_line(name)} <{mail}>" if name and mail and name != mail else mail or _one_line(name), "Subject": _one_line(_text(tree, SUBJECT))}
    for head, kind, shown in (("To", 1, SHOWN_TO), ("Cc", 2, SHOWN_CC), ("Bcc", 3, SHOWN_BCC)):
        heads[head] = ", ".join(people[kind]) or _one_line(_text(tree, shown))
    moment = _fixed(tree, SUBMITTED, 32 if top else 24) or _fixed(tree, DELIVERED, 32 if top else 24)
    if moment:
        heads["Date"] = (dt.datetime(1601, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=struct.unpack("<Q", moment)[0] // 10)).strftime("%a, %d %b %Y %H:%M:%S +0000")
    for head, value in heads.items():
        if value:
            try:
                out[head] = value
            except ValueError:
                out[head] = value.encode("ascii", "replace").decode()
    plain, raw = _text(tree, BODY), tree.get(f"__substg1.0_{HTML:04X}0102")
    html = raw.decode("utf-8", "replace") if isinstance(raw, bytes) else _text(tree, HTML)
    out.set_content(plain.replace("\r\n", "\n"))
    if html:
        out.add_alternative(html.replace("\r\n", "\n"), subtype="html")
    for file, data, kind, inline in attachments(tree):
        if isinstance(data, EmailMessage):
            out.add_attachment(data, filename=file)
        else:
            major, _, minor = kind.partition("/")
            out.add_attachment(data, maintype=major if minor else "application", subtype=minor or "octet-stream", filename=file, disposition="inline" if inline else "attachment")
    return out


def attachments(tree: dict) -> Iterator[tuple[str, bytes | EmailMessage, str, bool]]:
    """(name, bytes or message, media type, whether it is shown inside the text) of each attachment."""
    for n, part in enumerate(sorted(k for k in tree if k.startswith("__attach_version1.0_")), 1):
        a = tree[part]
        name = _one_line(_text(a, LONG_NAME) or _text(a, SHORT_NAME) or _text(a, NAME)) or f"attachment-{n}"
        inner = a.get(f"__substg1.0_{DATA:04X}000D")
        if isinstance(inner, dict):
            yield name if name.lower().endswith((".msg", ".eml")) else f"{name}.eml", message(inner, False), "message/rfc822", False
        else:
            yield name, a.get(f"__substg1.0_{DATA:04X}0102", b""), _text(a, MEDIA_TYPE).strip(), bool(_text(a, CONTENT_ID))


def outlook_mail(data: bytes) -> bytes:
    """An Outlook message file as the bytes of a mail; a compound file that holds none is refused."""
    tree = Compound(data).tree
    if "__properties_version1.0" not in tree:
        raise ValueError("no Outlook message")
    return message(tree).as_bytes()
