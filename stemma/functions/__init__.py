"""Scalar functions on columns: identifiers, paths, versions, package URLs.  All of them stay in the JVM."""
