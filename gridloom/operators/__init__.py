"""Operations from table to table."""
