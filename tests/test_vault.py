"""Documents of a run, and their way into folders and archives."""

import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.operators import chunks, vault
from factloom.plans import engine
from factloom.sources import files

CODE = """@RestController
@RequestMapping("/users")
public class UserController {
  @GetMapping("/{id}")
  public User find(String id) { return service.find(id); }
  @GetMapping("/{id}/")
  public User again(String id) { return find(id); }
}"""


def test_vault(spark, tmp_path):
    run = engine.analyse("r", files.in_memory(spark, {"src/UserController.java": CODE}))
    ends = run["facts"].filter("kind = 'http_endpoint'").select(
        "component_id", *(F.get_json_object("value_json", f"$.{n}").alias(a) for n, a in (("method", "method"), ("path", "path"), ("handler_expression", "handler"))), F.lit("ruta completa").alias("status")
    )
    docs = vault.vault(run["facts"], ends, run["edges"]).cache()
    paths = {r["path"] for r in docs.collect()}
    assert paths == {"Servicios/repo/main/servicio.md", "Servicios/repo/main/flujos/get-users-id.md", "Servicios/repo/main/flujos/get-users-id-2.md", "Servicios/repo/main/clases/UserController.md"}
    assert "| GET | /users/{id} |" in docs.filter("path like '%servicio.md'").first()["content"]
    assert vault.export_folder(docs, str(tmp_path / "v")) == 4 and (tmp_path / "v/Servicios/repo/main/servicio.md").read_text().startswith("# repo")
    vault.export_zip(docs, str(tmp_path / "a.zip"))
    vault.export_zip(docs.repartition(3), str(tmp_path / "b.zip"))
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes() and set(zipfile.ZipFile(tmp_path / "a.zip").namelist()) == paths
    with pytest.raises(ValueError):
        vault.export_folder(docs, str(tmp_path / "w"), most=1)
    with pytest.raises(ValueError):
        vault.export_folder(docs.withColumn("path", F.lit("../x.md")), str(tmp_path / "w"))
    own = chunks.build_chunks(docs, "r")
    assert {r[0] for r in own.select("document_type").distinct().collect()} == {"service", "flow", "class"}
