"""Operations of a training-data pipeline. Nothing outside imports this subpackage but the registration of queries."""
