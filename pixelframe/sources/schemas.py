"""Fixed schemas of the relational form: images, pixels, sources, fluxes, parameters, priors, masks."""

from __future__ import annotations

from pyspark.sql.types import StructType

PHOTOCAL = "struct<kind:string,scale:double,zp:double,band:string>"
SKY = "struct<kind:string,val:double>"
PSF = "array<struct<amp:double,mx:double,my:double,vxx:double,vxy:double,vyy:double>>"
WCS = "struct<crval1:double,crval2:double,crpix1:double,crpix2:double,cd11:double,cd12:double,cd21:double,cd22:double,x0:double,y0:double>"
SHAPE = "struct<re:double,e1:double,e2:double>"

DDL = {
    "images": f"img int, name string, band string, w int, h int, tai double, photocal {PHOTOCAL}, sky {SKY}, psf {PSF}, wcs {WCS}",
    "pixels": "img int, x int, y int, d double, iv double",
    "sources": f"sid bigint, type string, frame string, p1 double, p2 double, shape_exp {SHAPE}, shape_dev {SHAPE}, sersic double, fracdev double",
    "fluxes": "sid bigint, band string, flux double, comp string",
    "params": "pid int, owner string, name string, value double, liquid boolean, step double, lower double, upper double, maxstep double, shared_key int",
    "priors": "pid int, mu double, sigma double",
    "masks": "img int, sid bigint, x0 int, x1 int, y0 int, y1 int",
    "umod": "img int, sid bigint, comp int, x int, y int, u double",
    "deriv": "pid int, img int, x int, y int, v double",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
