"""Checks of columns for operators on several of them."""

from __future__ import annotations

from tessella.errors import TransformerInputError


class BaseValidator:
    """Sdtypes that an operator takes, and what their combination must be."""

    SUPPORTED_SDTYPES: tuple[str, ...] = ()

    @classmethod
    def validate_sdtypes(cls, columns_to_sdtypes: dict[str, str]) -> None:
        if bad := {c: s for c, s in columns_to_sdtypes.items() if s not in cls.SUPPORTED_SDTYPES}:
            raise TransformerInputError(f"{cls.__name__} can't take {bad}: use {list(cls.SUPPORTED_SDTYPES)}")

    @classmethod
    def validate_imports(cls) -> None:
        """Raise ImportError if the operator's package is missing."""

    @classmethod
    def validate(cls, columns_to_sdtypes: dict[str, str]) -> None:
        cls.validate_sdtypes(columns_to_sdtypes)
        cls.validate_imports()


class AddressValidator(BaseValidator):
    """Up to seven parts of an address, none twice, and one kind of region."""

    SUPPORTED_SDTYPES = ("country_code", "administrative_unit", "state", "state_abbr", "city", "postcode", "street_address", "secondary_address")
    MOST = 7

    @classmethod
    def validate_sdtypes(cls, columns_to_sdtypes):
        super().validate_sdtypes(columns_to_sdtypes)
        found = list(columns_to_sdtypes.values())
        if len(found) > cls.MOST:
            raise TransformerInputError(f"an address has {cls.MOST} columns at most")
        if len(set(found)) < len(found):
            raise TransformerInputError("an address has each part once")
        if len({"administrative_unit", "state", "state_abbr"} & set(found)) > 1:
            raise TransformerInputError("an address has one of administrative_unit, state and state_abbr")


class GPSValidator(BaseValidator):
    """A latitude and a longitude."""

    SUPPORTED_SDTYPES = ("latitude", "longitude")

    @classmethod
    def validate_sdtypes(cls, columns_to_sdtypes):
        super().validate_sdtypes(columns_to_sdtypes)
        if sorted(columns_to_sdtypes.values()) != ["latitude", "longitude"]:
            raise TransformerInputError("a position has one latitude and one longitude")
