import tarfile
import zipfile
from pathlib import Path

import pytest

from slovomer.sources import corpus, files

HEAD = "Класс: {g}\nКнига: Родная: речь\nГод: 1950\nРаздел: Весна\nТип: Рассказ\nНазвание: {s}\nАвтор: \n\n"


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "primer" / "grade_1"
    d.mkdir(parents=True)
    (d / "1").write_text(HEAD.format(g=1, s="Лиса") + "Лиса бежала.\nДалеко.\n")
    (d / "12abc").write_text(HEAD.format(g=1, s="Волк") + "Волк.")
    (d / "readme").write_text("нет")
    return tmp_path


def test_read(spark, root):
    c = corpus.primer_corpus(root)
    rows = {r.subject: r for r in c.get_records(spark).collect()}
    assert set(rows) == {"Лиса", "Волк"}
    r = rows["Лиса"]
    assert (r.grade, r.book, r.year, r.author, r.text) == (1, "Родная", 1950, "", "Лиса бежала.\nДалеко.") and r.file.endswith("grade_1/1")
    assert [x.text for x in c.get_texts(spark, subject="лис").collect()] == [r.text]
    assert c.get_records(spark, max_len=5).count() == 1 and c.get_records(spark, grade=1, limit=1).count() == 1 and c.get_records(spark, limit=0).count() == 0
    assert c.info["Наименование"] == "primer" and "primer" in repr(c) and c.filepath is None
    with pytest.raises(OSError):
        corpus.works_corpus(root).df(spark)
    with pytest.raises(RuntimeError):
        c.download()


def test_malformed(spark):
    good = HEAD.format(g=1, s="а") + "тело"
    rows = [("x/1", good), ("x/2", good + "\n\nещё"), ("x/3", "без"), ("x/a4", "без"), ("x/5", good.replace("Класс: 1", "Класс: один")), ("x/6", good.replace("Автор: ", "Автор")), ("x/7", None), (None, good)]
    df = spark.createDataFrame(rows, "path string, content string")
    assert [r.file for r in corpus.parse_files(df, malformed="drop").collect()] == ["x/1"]
    assert sorted(r.file for r in corpus.parse_files(df, malformed="keep").where("not ok").collect()) == ["x/2", "x/3", "x/5", "x/6", "x/7"]
    with pytest.raises(Exception, match="malformed file"):
        corpus.parse_files(df).collect()
    works = "Том: 1\nГод: 1901\nТип: Письмо\nПеревод: {}\nИсточник: а\nТема: б\nТопик: в\n\nтекст"
    df = spark.createDataFrame([("x/1", works.format(1)), ("x/2", works.format(0))], "path string, content string")
    assert {r.file: r.is_translation for r in corpus.parse_files(df, corpus.WORKS).collect()} == {"x/1": True, "x/2": False}


def test_filters(spark):
    df = spark.createDataFrame([(1, 1950, "Рассказ", "Весна", "Родная речь", "с", "а", "текст", "f1"), (2, None, None, None, None, None, None, None, "f2")], "grade int, year int, type string, category string, book string, subject string, author string, text string, file string")
    assert corpus.filter_records(df, grade=1, text_type="Рассказ", book="РЕЧЬ", min_len=5, max_len=5).count() == 1
    assert corpus.filter_records(df, year=0, book="").count() == 2
    for bad in (dict(grade=99), dict(volume=99), dict(text_type="?"), dict(min_len=-1), dict(max_len=-1), dict(min_len=5, max_len=2)):
        with pytest.raises(ValueError):
            corpus.filter_records(df, **bad)


def test_files(tmp_path):
    assert files.to_path("a") == Path("a")
    with pytest.raises(TypeError):
        files.to_path(5)
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.txt").write_text("а")
    with tarfile.open(tmp_path / "pack.tar.xz", "w:xz") as t:
        t.add(tmp_path / "src", "inner")
    out = files.extract_archive(tmp_path / "pack.tar.xz", tmp_path / "out")
    assert out == str(tmp_path / "out" / "pack") and (Path(out) / "x.txt").read_text() == "а"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "src" / "x.txt", "z/x.txt")
    assert files.extract_archive(tmp_path / "z.zip") == str(tmp_path / "z")
    assert files.extract_archive(tmp_path / "src" / "x.txt") == str(tmp_path / "src")
    url = (tmp_path / "src" / "x.txt").as_uri()
    got = files.download_file(url, dirpath=tmp_path / "dl")
    assert Path(got).read_text() == "а" and files.download_file(url, dirpath=tmp_path / "dl") == ""
    with pytest.raises(RuntimeError):
        files.download_file((tmp_path / "no").as_uri(), dirpath=tmp_path / "dl")
