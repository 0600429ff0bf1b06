"""Analytics over facts about programs and their test runs, as PySpark DataFrame operators."""
