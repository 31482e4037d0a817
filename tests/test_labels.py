from pagemill.sources import labels


def put(root, *paths, **tables):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"x")
    for p, text in tables.items():
        raise AssertionError(p, text)


def read(spark, root, name):
    return {r.path: r for r in labels.read_dataset_labels(spark, f"file://{root}", name).collect()}


def test_paths_say_what_an_image_is(spark, tmp_path):
    put(tmp_path, "fold/a.png", "Other/b.jpg", ".hidden/c.png", "fold/readme.txt")
    got = read(spark, tmp_path, "warpdoc")
    assert set(got) == {"fold/a.png", "Other/b.jpg"}
    assert got["fold/a.png"].raw["distortion_type"] == "fold" and got["fold/a.png"].raw["expected_degradations"] == "fold,warping"
    assert got["Other/b.jpg"].raw["distortion_type"] == "unknown" and got["Other/b.jpg"].raw["is_degraded"] == "true"


def test_script_folders(spark, tmp_path):
    put(tmp_path, "Training/Arabic/1.png", "Testing/Elvish/2.png", "loose.png")
    got = read(spark, tmp_path, "cvsi")
    a = got["Training/Arabic/1.png"]
    assert (a.language_code, a.iso15924_script_code, a.raw["split"]) == ("ar", "Arab", "training")
    assert got["Testing/Elvish/2.png"].language_code is None and got["Testing/Elvish/2.png"].raw["script_class"] == "Elvish"
    assert dict(got["loose.png"].raw) == {}


def test_ground_truth_is_looked_for(spark, tmp_path):
    put(tmp_path, "train/input/1.png", "train/target/1.png", "train/input/2.png")
    got = read(spark, tmp_path, "sd7k")
    assert got["train/input/1.png"].raw["ground_truth_path"] == "train/target/1.png" and got["train/input/1.png"].raw["has_ground_truth"] == "true"
    assert got["train/input/2.png"].raw["has_ground_truth"] == "false" and got["train/target/1.png"].raw["image_type"] == "ground_truth"
    put(tmp_path / "s", "src/1.png", "gt/1.png")
    assert read(spark, tmp_path / "s", "drccbi")["src/1.png"].raw["ground_truth_path"] == "gt/1.png"


def test_tables_join_by_name_or_stem(spark, tmp_path):
    put(tmp_path / "d", "train/ori/1.png", "train/res/1r.png", "val/ori/9.png")
    (tmp_path / "d/train/train.csv").write_text("ori,res,overall,sharpness,color_fidelity\n1.png,1r.png,3.5,2.5,4.0\n")
    got = read(spark, tmp_path / "d", "diqa-5000")
    assert got["train/ori/1.png"].raw["overall"] == "3.5" and got["train/ori/1.png"].raw["paired_image"] == "1r.png"
    assert got["train/res/1r.png"].raw["paired_image"] == "1.png" and got["train/res/1r.png"].raw["is_synthetic_degradation"] == "true"
    assert "overall" not in got["val/ori/9.png"].raw
    put(tmp_path / "k", "AB1_Para2_3.tif")
    (tmp_path / "k/khatt_groundtruth.tsv").write_text("image_path\tarabic_text\tsplit\nx/AB1_Para2_3.tif\tnass\ttrain\n")
    k = read(spark, tmp_path / "k", "khatt-arabic")["AB1_Para2_3.tif"]
    assert (k.transcription, k.writer_id, k.raw["segment"], k.iso15924_script_code) == ("nass", "AB1", "3", "Arab")


def test_quads_and_forms(spark, tmp_path):
    put(tmp_path / "q", "a.jpg", "b.jpg")
    (tmp_path / "q/a.txt").write_text("1,2,3,4,5,6,7,8,Total, due\nbad line\n1,2,3,4,5,6,7,8,now\n")
    got = read(spark, tmp_path / "q", "sroie")
    assert got["a.jpg"].transcription == "Total, due now" and got["a.jpg"].raw["text_instances"] == "2" and got["b.jpg"].transcription is None
    put(tmp_path / "m", "t.jpg")
    (tmp_path / "m/t.txt").write_text("1,2,3,4,5,6,7,8,Arabic,nass\n1,2,3,4,5,6,7,8,Latin,###\n")
    m = read(spark, tmp_path / "m", "mlt19")["t.jpg"]
    assert m.raw["languages"] == "Arabic,Latin" and m.transcription == "nass"
    put(tmp_path / "f", "images/x.png")
    (tmp_path / "f/annotations").mkdir()
    (tmp_path / "f/annotations/x.json").write_text('{"form": [{"text": "Name:", "label": "question"}, {"text": "", "label": "other"}, {"text": "Ann", "label": "answer"}]}')
    assert read(spark, tmp_path / "f", "funsd")["images/x.png"].transcription == "Name: Ann"


def test_an_unknown_dataset_has_paths_only(spark, tmp_path):
    put(tmp_path, "x/1.png")
    r = read(spark, tmp_path, "nobody knows")["x/1.png"]
    assert r.transcription is None and dict(r.raw) == {}
