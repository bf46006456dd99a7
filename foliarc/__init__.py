"""Document-evidence analytics as PySpark DataFrame operators.

``foliarc.functions``  column expressions (text, numbers, hashing, redaction, ranking)
``foliarc.sources``    scans, manifests and sinks
``foliarc.operators``  DataFrame-in / DataFrame-out operators
``foliarc.plans``      the operators applied to the test tables, with their SQL twins
``foliarc.streaming``  Structured Streaming jobs
"""
