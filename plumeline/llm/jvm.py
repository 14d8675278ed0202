"""SQL functions written in Java, for loops that neither SQL's expressions nor NumPy run well.

The source beside this module is compiled by the compiler that Spark itself generates code with, packed into a jar in the
folder that the cluster shares, and added to the session, which sends it to every executor.
"""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession

from .common import new_path


def _jar(jvm: JavaObject, source: str) -> bytes:
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.cook(source)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as jar:
        for name, code in dict(compiler.getBytecodes()).items():
            jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
    return out.getvalue()


def register(spark: SparkSession, source: str, functions: dict[str, tuple[str, str]]) -> None:
    """Make ``functions`` (SQL name: class in the file ``source``, and the type that it returns) known to the session, once."""
    session = spark._jsparkSession
    missing = {name: of for name, of in functions.items() if not spark.catalog.functionExists(name)}
    if not missing:
        return
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{new_path(spark, Path(source).stem)}.jar")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(_jar(jvm, (Path(__file__).parent / source).read_text(encoding="utf-8"))))
    out.close()
    spark.sql(f"ADD JAR '{path.toString()}'")
    for name, (of, returned) in missing.items():
        found = jvm.java.lang.Class.forName(of, True, session.sharedState().jarClassLoader()).getDeclaredConstructors()[0]
        found.setAccessible(True)
        session.udf().register(name, found.newInstance(context._gateway.new_array(jvm.java.lang.Object, 0)), jvm.org.apache.spark.sql.types.DataType.fromDDL(returned))
