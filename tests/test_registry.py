import pytest

from tarn.operators.registry import Step, Template, builtin_registry


def test_register_and_list(spark):
    reg = builtin_registry()
    step = Step("ocr", "png", "md", ("page_image",), ("ocr_text",), lambda df: df, "lexical")
    reg.register(step)
    with pytest.raises(ValueError):
        reg.register(step)
    assert reg.lineage_rules(spark).filter("output_rep = 'ocr_text'").count() == 1
    assert {r["name"] for r in reg.listing(spark).collect()} >= {"ocr", "markdown", "chunks", "md_passthru"}
    reg.unregister("step", "ocr")
    with pytest.raises(KeyError):
        reg.unregister("step", "ocr")
    with pytest.raises(KeyError):
        reg.get("step", "ocr")


def test_extension_case(spark):
    reg = builtin_registry()
    assert reg.for_extension(".MD").name == "markdown"
    assert reg.for_extension(".zip") is None
    reg.register(Template("pdf", (".pdf",), "document", "pdf_to_png"))
    assert reg.ext_routes(spark).filter("ext = '.pdf' AND format = 'pdf'").count() == 1


def test_missing_converter(spark):
    with pytest.raises(NotImplementedError):
        builtin_registry().get("step", "word_to_pdf").transform(spark.range(1))
