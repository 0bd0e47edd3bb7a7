"""vectorloom: Spark jobs that turn tables and streams of text into vector tables.

The package is a set of ``DataFrame -> DataFrame`` functions:

* :mod:`vectorloom.sources`    request and text readers, vector / response / dead-letter sinks
* :mod:`vectorloom.functions`  column expressions (prompts, tokens, vectors, validation)
* :mod:`vectorloom.operators`  joins, aggregates and Arrow stages built from them
* :mod:`vectorloom.encoders`   the plug-in interface for embedding models
* :mod:`vectorloom.plans`      whole jobs (bulk embedding) and the registered queries
* :mod:`vectorloom.streaming`  the same jobs on Structured Streaming
"""
