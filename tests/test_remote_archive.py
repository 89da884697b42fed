import io
import zipfile

from quarrystone.sources import remote_archive


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"doc_{i}.html", f"text {i} " * 50)
        z.writestr("big.bin", bytes(range(256)) * 4000, zipfile.ZIP_STORED)
        z.writestr("last.html", "end")
    return out.getvalue()


def test_members_come_in_few_requests():
    data, asked = archive(), []

    def ranged(a, b):
        asked.append(b - a)
        return data[a:b]

    got = dict(remote_archive.members(ranged, len(data), lambda n: n.endswith(".html"), gap=1000))
    assert len(got) == 41 and got["doc_7.html"] == b"text 7 " * 50 and got["last.html"] == b"end"
    assert len(asked) <= 8


def test_a_wide_gap_joins_all():
    data = archive()
    infos = remote_archive.index(lambda a, b: data[a:b], len(data))
    assert len(remote_archive.spans(infos, 1 << 30)) == 1 and len(remote_archive.spans([i for i in infos if i.filename != "big.bin"], 0)) == 2
