"""terraframe: a PySpark engine for geographic map data and training corpora."""
