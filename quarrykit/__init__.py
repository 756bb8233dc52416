"""File-index search, usage ranking, duplicate detection, tree resolution and exam-text structuring on PySpark."""
