"""A header is parsed once, however often a part is asked for it."""
import email.headerregistry
import email.policy

from bundleflow.sources import mail


def _mail(parts):
    body = "".join(f'--b\nContent-Type: application/pdf; name="n{i}.pdf"\nContent-Disposition: attachment; filename="f {i}.pdf"\n'
                   f"Content-Transfer-Encoding: base64\n\nAAEC\n" for i in range(parts))
    return (f'From: "A, B" <a@x.de>\nSubject: =?utf-8?q?caf=C3=A9?=\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="b"\n\n'
            f"--b\nContent-Type: text/plain\n\nhello\n{body}--b--\n").encode()


ODD = [_mail(3), b"", b"\xff\xfe", b"Subject: s\n\nbody", b"Content-Type: multipart/mixed; boundary=\n\n--\nx", b"Subject: \xe9\n b\n\nx",
       b'Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Disposition: attachment; filename*0="a"; filename*1=".pdf"\n\nx\n--b--',
       b'Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Disposition: ATTACHMENT; filename=\n\nx\n--b\nContent-Type: ;\n\n--b--']


def test_headers_of_a_part_are_parsed_once(monkeypatch):
    parsed, parse = [], email.headerregistry.HeaderRegistry.__call__
    monkeypatch.setattr(email.headerregistry.HeaderRegistry, "__call__", lambda self, name, value: parsed.append(name) or parse(self, name, value))
    row = mail._read_one("p", _mail(40))
    assert [a["file_name"] for a in row["attachments"]] == [f"f {i}.pdf" for i in range(40)]
    assert (row["subject"], row["error"]) == ("café", None)
    assert len(parsed) <= 3 * 40 + 10


def test_mails_read_as_by_the_default_policy(monkeypatch):
    ours = [mail._read_one("p", raw) for raw in ODD * 2]
    monkeypatch.setattr(mail, "_POLICY", email.policy.default)
    assert ours == [mail._read_one("p", raw) for raw in ODD * 2]
