import json

from logferry.functions import jsontext as J
from logferry.operators.files import text_of, utf16_kind
from logferry.operators.touches import attachment_file
from pyspark.sql import functions as F

DOC = json.dumps({"b": [1.0, {"c\"d": "x\ny", "a": "z\\"}], "t": True, "s": "q:\"{"}, ensure_ascii=False)


def test_blank_and_replace(column):
    (out,) = column([DOC], lambda c: J.blank_strings(c, F.lit('no "te"')))
    assert json.loads(out) == {"b": [1.0, {"c\"d": 'no "te"', "a": 'no "te"'}], "t": True, "s": 'no "te"'}
    (out,) = column([DOC], lambda c: J.replace_in_strings(c, F.lit("\ny"), F.lit('"é')))
    assert json.loads(out)["b"][1]["c\"d"] == 'x"é'
    assert column([DOC], J.strings) == [["x\ny", "z\\", 'q:"{']]


def test_structure(column):
    doc = {
        "type": "hidden", "text": "é1", "list": ["ab", {"type": ["x", {"k": "no"}], "v": "cde"}],
        "img": {"type": "base64", "data": "AAAA", "deep": {"data": "in"}}, "url": "data:image/png;x", "n": {"type": 1, "z": "yes"},
    }
    (got,) = column([json.dumps(doc)], J.structure)
    assert (got.bytes, got.images) == (len("é1".encode()) + 2 + 3 + 3, 2)
    tokens = [t for t in json.dumps(doc).split('"')[1::2]]
    assert [tokens[i] for i in got.opaque] == ["AAAA"]


def test_attachment_file(column):
    docs = [
        {"type": "x", "content": {"file": {"filePath": "/p/.env"}}},
        {"a": {"path": "deep"}, "path": "own"},
        {"file_path": "last", "filename": "first"},
        {"z": {"path": "late"}, "b": [{"q": 1}, {"path": "early"}]},
        {"path": {"path": "inner"}},
        {"q": "none"},
    ]
    got = column([json.dumps(d, sort_keys=True) for d in docs], attachment_file)
    assert got == ["/p/.env", "own", "first", "early", "inner", None]


def test_text_of_bytes(column):
    text = "$password = 'hunter22xx'"
    le, be = text.encode("utf-16-le"), text.encode("utf-16-be")
    cases = [b"\xff\xfe" + le, le, be, b"\xfe\xff" + be, b"ok \xff", "é".encode()]
    assert column(cases, text_of, "x binary") == [text] * 4 + ["ok \ufffd", "é"]
    assert column(cases, utf16_kind, "x binary") == ["LE", "LE", "BE", "BE", None, None]
