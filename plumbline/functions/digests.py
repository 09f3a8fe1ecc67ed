"""SHA-256 of whole files, read as streams within the tasks."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.classic.column import _to_seq

# Fixed value: bytes read at a time, and all that a task holds of a file.
BUFFER_BYTES = 1 << 16


def file_sha256(spark: SparkSession, path: Column) -> Column:
    """Hex digest of the file a path names, for paths as Spark's file sources give them.

    Spark's readers give a file's bytes as one row, all in memory and 2 GB at most. SQL has no function
    that reads a file otherwise, so this is an expression of Java calls, as encoders use them: the task
    with the row opens the file by Hadoop's client, with the session's settings, and the digest reads it
    through one buffer. The stream closes itself at its end; an error fails the task.
    """
    java = spark._jvm
    catalyst, utils = java.org.apache.spark.sql.catalyst.expressions, java.org.apache.spark.sql.classic.ExpressionUtils

    def seq(arguments=()):
        return _to_seq(spark.sparkContext, list(arguments))

    def kind(name: str):
        return java.org.apache.spark.sql.types.ObjectType(java.org.apache.spark.util.Utils.classForName(name, True, False))

    def new(name: str, *arguments):
        of = kind(name)
        return catalyst.objects.NewInstance(of.cls(), seq(arguments), seq(), True, of, java.scala.Option.empty())

    def call(target, method: str, result, *arguments):
        return catalyst.objects.Invoke(target, method, result, seq(arguments), seq(), True, True, True)

    def value(column: Column):
        return utils.expression(column._jc)

    text = kind("java.lang.String")
    settings = catalyst.Literal.fromObject(
        java.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf()))
    place = new("org.apache.hadoop.fs.Path", call(value(path), "toString", text))
    store = call(place, "getFileSystem", kind("org.apache.hadoop.fs.FileSystem"),
                 call(settings, "value", kind("org.apache.hadoop.conf.Configuration")))
    stream = new("java.io.BufferedInputStream", call(store, "open", kind("org.apache.hadoop.fs.FSDataInputStream"), place),
                 value(F.lit(BUFFER_BYTES)))
    digest = new("org.apache.commons.codec.digest.DigestUtils", catalyst.Literal.fromObject("SHA-256"))
    hexadecimal = call(digest, "digestAsHex", text, new("org.apache.commons.io.input.AutoCloseInputStream", stream))
    return Column(utils.column(catalyst.objects.StaticInvoke(
        kind("org.apache.spark.unsafe.types.UTF8String").cls(), java.org.apache.spark.sql.types.DataTypes.StringType,
        "fromString", seq([hexadecimal]), seq(), True, True, True, java.scala.Option.empty())))
