"""Operations of a training-data pipeline over ``documents``; see ``queries.py`` for what is registered."""
